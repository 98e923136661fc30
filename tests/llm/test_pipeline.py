"""Each stage of the pipeline against what it should do to its own input."""

import re
from collections import Counter

import corpus_pipeline
from weft.llm.common import table
from weft.llm import nbsvm

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        held[name] = (docs, spark.read.parquet(str(tmp_path / str(k))))
        docs = held[name][1]
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "suffix-array dedup", "source mixing", "packing"]

    before, after = (x.toPandas() for x in held["quality classifier"])
    good = nbsvm.score(table(spark, SF, "documents"), nbsvm.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))).where("score >= 0.5").toPandas()
    assert sorted(after["doc_id"]) == sorted(good["doc_id"])

    before, after = (x.toPandas() for x in held["minhash near-dedup"])
    sets = {}
    for i, t in zip(before["doc_id"], before["text"]):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    assert sorted(after["doc_id"]) == [i for i in ids if root[i] == i]

    before, after = (x.toPandas() for x in held["suffix-array dedup"])
    assert sorted(before["doc_id"]) == sorted(after["doc_id"]) and (after["n_chars"] == after["text"].str.len()).all()
    seen = Counter()
    for t in after["text"]:
        raw = t.encode()
        seen.update({raw[p : p + 200] for p in range(len(raw) - 199)})
    old = Counter()
    for t in before["text"]:
        raw = t.encode()
        old.update({raw[p : p + 200] for p in range(len(raw) - 199)})
    # Strings that several documents held are left in one of them; every string of the old texts that was unique and whole is untouched.
    assert not [s for s, n in seen.items() if n > 1 and s in old]

    before, after = (x.toPandas() for x in held["source mixing"])
    taken = Counter(zip(after["doc_id"], after["text"]))
    assert set(taken) <= set(zip(before["doc_id"], before["text"])) and max(taken.values()) <= 2
    size = lambda d: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in d["text"])
    assert abs(size(after) - 1.5 * size(before)) <= 0.002 * size(before) + before["source"].nunique()

    before, after = (x.toPandas() for x in held["packing"])
    assert Counter(after[after["start"] == 0]["doc_id"]) == Counter(before["doc_id"]) and after.groupby("sequence_id")["length"].sum().max() <= 1024


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_entry_registers_all(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)}
