"""Edit-distance name join: a universal Levenshtein automaton over a sharded trie of names.

Distance is optimal string alignment: insertions, deletions and substitutions of one
code point and exchanges of two adjacent ones, no substring edited twice.  Pairs of
names of distance ``BOUND`` (2) at most are found; bounds of 1 and 2 are possible.

Universal automaton.  Its states are sets of positions relative to the number of code
points read, so they depend on neither name; it reads, for each code point, which of
the next few places of the query name hold it.  A position (d, e) has used ``e`` edits
and stands ``d`` places ahead; a position in exchange has read the second of two
exchanged code points and waits for the first.  States and transitions are found when
they first occur and kept.

Shards.  Cut a name anywhere: of two edits, one half holds at most one.  So each
distinct name enters two tries, one by its beginning (its first half, ``HEAD`` code
points at most) and one by its end, read backwards.  A shard holds the names of one
beginning and one length.  A query name is sent to the shards whose beginning is
within one edit of one of its own beginnings.  Such beginnings share what is left
after taking out at most one code point, so shards and queries meet by an equi-join
on that.  Shards with many names or queries are dealt to cells of about ``CELL`` names
by ``CELL`` queries.  In a cell the names make a trie, and the automaton runs over it
once for each query.  A pair that both tries find is kept by the forward one.  The
distance of every accepted pair is computed again from both names.

Only distinct names travel, with their aggregates, so rows that share a name cost one.
Names null or empty take no part.  Nothing goes through one task, the driver or a
broadcast: joins are merge joins whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Workspace, groups, map_rows

#: Largest distance; code points of a beginning; names and queries of a cell.
BOUND, HEAD, CELL = 2, 12, 400
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Universal:
    """The universal automaton of optimal string alignment distance ``bound``; state 0 is the start, -1 has no way on."""

    def __init__(self, bound: int = BOUND):
        self.bound = bound
        self.mask = (1 << (2 * bound + 2)) - 1
        start = frozenset({(0, 0, False)})
        self.number, self.states = {start: 0}, [start]
        self.moves: dict[int, int] = {}
        self.left: dict[tuple[int, int], int | None] = {}

    def step(self, state: int, bits: int) -> int:
        """Bit k of ``bits``: the place k - bound ahead of those read holds the code point."""
        key = state << 8 | bits
        to = self.moves.get(key)
        if to is None:
            to = self.moves[key] = self._step(self.states[state], bits)
        return to

    def _step(self, positions: frozenset, bits: int) -> int:
        k, new = self.bound, set()
        holds = lambda d: d >= -k and bits >> (d + k) & 1
        for d, e, exchange in positions:
            if exchange:
                if holds(d):
                    new.add((d + 1, e, False))
            elif holds(d):
                new.add((d, e, False))
            elif e < k:
                new |= {(d - 1, e + 1, False), (d, e + 1, False)}
                new |= {(d + q, e + q, False) for q in range(1, k - e + 1) if holds(d + q)}
                if holds(d + 1):
                    new.add((d - 1, e + 1, True))
        # A position is needless if another, with fewer edits, can be where it is by spending the difference.
        plain = [(d, e) for d, e, exchange in new if not exchange]
        kept = frozenset(p for p in new if p[2] or not any(e < p[1] and abs(d - p[0]) <= p[1] - e for d, e in plain))
        if not kept:
            return -1
        if kept not in self.number:
            self.number[kept] = len(self.states)
            self.states.append(kept)
        return self.number[kept]

    def distance(self, state: int, rest: int) -> int | None:
        """The least distance if ``rest`` code points of the query are left (negative: fewer than were read); None beyond the bound."""
        key = (state, rest)
        if key not in self.left:
            best = min((e + rest - d for d, e, exchange in self.states[state] if not exchange and d <= rest), default=self.bound + 1)
            self.left[key] = best if best <= self.bound else None
        return self.left[key]

    def near(self, state: int, rest: int) -> bool:
        """Whether what was read is within the bound of some beginning of the query."""
        return any(not exchange and d <= rest for d, _, exchange in self.states[state])

    def masks(self, query: str) -> dict[str, int]:
        """For each code point the places that hold it, shifted for ``step``."""
        out: dict[str, int] = {}
        for i, c in enumerate(query):
            out[c] = out.get(c, 0) | 1 << (i + self.bound)
        return out

    def read(self, text: str, masks: dict[str, int]) -> int:
        state, step, get, mask = 0, self.step, masks.get, self.mask
        for j, c in enumerate(text):
            state = step(state, get(c, 0) >> j & mask)
            if state < 0:
                return -1
        return state


def alignment(a: str, b: str) -> int:
    """Optimal string alignment distance of two names."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


class Trie:
    """Names of one length as nested maps by code point; the last map of a name holds its place."""

    def __init__(self, names: list[str]):
        self.root: dict = {}
        self.size = len(names[0])
        for k, name in enumerate(names):
            node = self.root
            for c in name[:-1]:
                node = node.setdefault(c, {})
            node[name[-1]] = k

    def search(self, automaton: Universal, query: str) -> Iterator[int]:
        """Places of the names within the automaton's bound of ``query``."""
        masks, step, mask, size, rest = automaton.masks(query), automaton.step, automaton.mask, self.size, len(query) - self.size
        if abs(rest) > automaton.bound:
            return
        stack = [(self.root, 0, 0)]
        while stack:
            node, state, j = stack.pop()
            for c, child in node.items():
                to = step(state, masks.get(c, 0) >> j & mask)
                if to < 0:
                    continue
                if j + 1 < size:
                    stack.append((child, to, j + 1))
                elif automaton.distance(to, rest) is not None:
                    yield child


def lowered(name: Column) -> Column:
    return F.translate(name, UPPER, LOWER)


def misspelt(name: Column, number: Column) -> Column:
    """``name`` with two adjacent code points exchanged if ``number`` is even: those at ``number`` mod (length - 1) and after."""
    size = F.length(name)
    at = (number % F.greatest(size - 1, F.lit(1)) + 1).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.lit(1)), F.substring(name, at, F.lit(1)), F.substring(name, at + 2, size))
    return F.when((number % 2 == 0) & (size >= 2), swapped).otherwise(name)


def _without_one(text: Column) -> Column:
    """All strings that are ``text`` less one code point; none of an empty text."""
    size = F.length(text)
    places = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, size)))


def _head_size(size: Column, backward: bool) -> Column:
    half = F.floor(size / 2).cast("int")
    return F.least(size - half if backward else half, F.lit(HEAD))


def _sides(df: DataFrame, name: str) -> DataFrame:
    """Each name forwards and backwards: (back, word)."""
    return df.select("*", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col(name).alias("word")), F.struct(F.lit(True).alias("back"), F.reverse(name).alias("word")))).alias("side")).select(*df.columns, "side.*")


def _routes(heads: DataFrame, queries: DataFrame, bound: int) -> DataFrame:
    """(back, size, head, query): the shards each query name has to visit."""
    # What is left of a beginning, whole or less one code point.
    a = heads.select("back", "size", "head", F.explode(F.array_append(_without_one(F.col("head")), F.col("head"))).alias("left")).distinct()
    sized = _sides(queries, "query").select("query", "back", "word", F.explode(F.sequence(F.greatest(F.length("query") - bound, F.lit(1)), F.length("query") + bound)).alias("size"))
    h = F.when(F.col("back"), _head_size(F.col("size"), True)).otherwise(_head_size(F.col("size"), False))
    cut = sized.withColumn("h", h).withColumns({"same": F.substring("word", F.lit(1), F.col("h")), "more": F.substring("word", F.lit(1), F.col("h") + 1)})
    left = F.array_distinct(F.flatten(F.array(
        F.array("same", F.substring("word", F.lit(1), F.greatest(F.col("h") - 1, F.lit(0)))), _without_one(F.col("same")), F.when(F.length("more") > F.col("h"), _without_one(F.col("more"))).otherwise(F.array().cast("array<string>")),
    )))
    b = cut.select("query", "back", "size", F.explode(left).alias("left"))
    return a.join(b.hint("merge"), ["back", "size", "left"]).select("back", "size", "head", "query").distinct()


def _cell(names: list[str], rows: list[tuple], queries: Iterator[str], head: str, back: bool, wide: Universal, narrow: Universal) -> Iterator[tuple]:
    """(query, distance, n, first, crc) of each pair of the cell that this side has to report; ``names`` are read in the side's direction."""
    trie = None
    forward = None
    for query in queries:
        word = query[::-1] if back else query
        state = narrow.read(head, masks := narrow.masks(word))
        if state < 0 or not narrow.near(state, len(word) - len(head)):
            continue
        trie = trie or Trie(names)
        for k in trie.search(wide, word):
            if back:
                forward = forward or [name[::-1][: min(len(name) // 2, HEAD)] for name in names]
                masks = narrow.masks(query)
                s = narrow.read(forward[k], masks)
                if s >= 0 and narrow.near(s, len(query) - len(forward[k])):
                    continue
            d = alignment(word, names[k])
            if d <= wide.bound:
                yield query, d, *rows[k]


def pairs(queries: DataFrame, names: DataFrame, bound: int = BOUND) -> DataFrame:
    """(query, distance, n, first, crc) of each distinct query name and distance with a name near it, its aggregates summed up.

    ``queries`` (query) and ``names`` (name, n, first, crc) hold each name once, none
    null or empty.
    """
    spark = queries.sparkSession
    space = Workspace(spark, "names")
    both = _sides(names, "name").withColumn("size", F.length("name"))
    h = F.when(F.col("back"), _head_size(F.col("size"), True)).otherwise(_head_size(F.col("size"), False))
    both = space.write(both.withColumn("head", F.substring("word", F.lit(1), h)).drop("name"), "sides")
    shard = ["back", "size", "head"]
    heads = both.groupBy(*shard).agg(F.count(F.lit(1)).alias("n_names"))
    routes = space.write(_routes(heads.select(*shard), queries, bound), "routes")
    counts = space.write(routes.groupBy(*shard).agg(F.count(F.lit(1)).alias("n_queries")).join(heads.hint("merge"), shard), "shards")
    parts = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    sized = counts.select(*shard, parts("n_names").alias("rows"), parts("n_queries").alias("columns"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = both.join(sized.hint("merge"), shard).select(*shard, own("word", "rows").alias("r"), each("columns").alias("c"), F.lit(False).alias("asks"), "word", "n", "first", "crc")
    none = F.lit(None).cast("bigint")
    right = routes.join(sized.hint("merge"), shard).select(*shard, each("rows").alias("r"), own("query", "columns").alias("c"), F.lit(True).alias("asks"), F.col("query").alias("word"), none.alias("n"), none.alias("first"), none.alias("crc"))
    cell = [*shard, "r", "c"]
    dealt = left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell, "asks", "word")

    def run(batches):
        wide, narrow = Universal(bound), Universal(1)
        out: dict[tuple[str, int], list] = {}

        def flush() -> dict:
            rows = [(q, d, *v) for (q, d), v in out.items()]
            out.clear()
            return {c: [r[i] for r in rows] for i, c in enumerate(("query", "distance", "n", "first", "crc"))}

        for (back, _, head, _, _), rows in groups(batches, tuple(cell)):
            at = rows["asks"].index(True) if True in rows["asks"] else len(rows["asks"])
            if not at:
                continue
            values = list(zip(rows["n"][:at], rows["first"][:at], rows["crc"][:at]))
            for query, d, n, first, crc in _cell(rows["word"][:at], values, iter(rows["word"][at:]), head, back, wide, narrow):
                v = out.setdefault((query, d), [0, None, 0])
                v[0], v[2] = v[0] + n, v[2] + crc
                if first is not None:
                    v[1] = first if v[1] is None else min(v[1], first)
            if len(out) >= 1 << 15:
                yield flush()
        yield flush()

    found = map_rows(dealt, run, "query string, distance int, n bigint, first bigint, crc bigint")
    return found.groupBy("query", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))


def decimal_crc(number: Column) -> Column:
    """Unsigned crc32 of the decimal form."""
    return F.crc32(number.cast("string").cast("binary"))


def join(clients: DataFrame, vendors: DataFrame, bound: int = BOUND) -> DataFrame:
    """(vendor_id, distance, n_clients, first_client_id, clients_crc) of vendors and distances with clients near the misspelt name.

    Rows count as often as they stand: client rows that repeat an id are counted
    each, and so are those of a vendor that repeats.  A vendor without id has no
    misspelling and takes no part; a client without id counts and adds no id.
    """
    named = clients.select(F.col("client_id").cast("bigint").alias("client_id"), lowered(F.col("name")).alias("name")).where("name is not null and name != ''")
    names = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("client_id").alias("first"), F.coalesce(F.sum(decimal_crc(F.col("client_id"))), F.lit(0)).alias("crc"))
    asked = vendors.where("vendor_id is not null and name is not null").select(F.col("vendor_id").cast("bigint").alias("vendor_id"), lowered(misspelt(F.col("name"), decimal_crc(F.col("vendor_id")))).alias("query")).where("query != ''")
    found = pairs(asked.select("query").distinct(), names, bound)
    return asked.join(found.hint("merge"), "query").groupBy("vendor_id", "distance").agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc"))
