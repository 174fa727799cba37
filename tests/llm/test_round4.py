"""The pipeline's near-duplicate stage is operator 6: fingerprints, BK-trees, components."""

from rankloom.llm import simhash, stages


def test_near_duplicate_stage_goes_by_bk_trees(spark, monkeypatch):
    words = [f"w{n}" for n in range(400)]
    changed = [*words[:200], "other", *words[201:]]
    texts = {1: " ".join(words), 2: " ".join(words).upper(), 3: " ".join(changed), 4: " ".join(reversed(words)), 5: None, 6: "", 7: "a b", 8: " ".join(f"x{n}" for n in range(300))}
    rows = [*texts.items(), (None, " ".join(words)), (8, "another text of the same document")]
    fps = {i: simhash.fingerprint(simhash.shingle_hashes(t or "", 3)) for i, t in texts.items()}
    low = {i: min(j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}  # here links are transitive
    assert low[2] == 1 and low[6] == 5 and low[4] == 4
    used = []
    real = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *a: used.append(1) or real(*a))
    monkeypatch.setattr(simhash, "near_groups", None)
    got = [(r.doc_id, r.text) for r in stages.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert used and sorted((i or 0) for i, _ in got) == sorted([0, *(i for i in low if low[i] == i)])
    assert (8, "another text of the same document") in got
