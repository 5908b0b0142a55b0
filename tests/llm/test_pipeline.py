"""The pipeline on the smallest tables: its stages only drop, redact or add as they say."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "sentencepiece"]
    assert set(docs.columns) < set(out.columns) and 0 < out.count() <= docs.count()
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    assert out.where("n_pieces <> size(piece_ids) or n_chars is null").count() == 0


def test_last_stage_decodes(spark):
    import sentencepiece as lib

    sp = lib.SentencePieceProcessor(model_file=corpus_pipeline.sentencepiece.MODEL_PATH)
    texts = ["a plain text", "", None, "two  blanks\n", "the sign \u2581 itself"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in corpus_pipeline.encode_pieces(spark, docs, SF).collect()}
    assert [rows[i]["round_trip"] for i in range(5)] == [True, True, True, True, False]
    assert all(rows[i]["piece_ids"] == (None if t is None else sp.encode(t)) for i, t in enumerate(texts)) and "_decoded" not in rows[0].asDict()


def test_stages_keep_edge_rows_and_columns(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = spark.read.parquet(f"{SF}/documents.parquet").join(labels.where("quality = 1"), "doc_id", "left_semi").limit(30)
    kind = "doc_id long, text string, lang string, source string, n_chars long, _score string, _before string, _root int, spans string"
    edge = spark.createDataFrame([(10**9, None, None, None, None, "a", "b", 1, "c"), (10**9 + 1, "", "en", "x", 0, "a", "b", 1, "c"), (10**9 + 2, "password: hunter2hunter2", "en", "x", 24, "a", "b", 1, "c")], kind)
    docs = texts.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'a' _score", "'b' _before", "1 _root", "'c' spans").unionByName(edge)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert set(docs.columns) <= set(out.columns) and {(r["_score"], r["_before"], r["_root"], r["spans"]) for r in rows} == {("a", "b", 1, "c")}, name
        if name != "quality":
            assert {10**9, 10**9 + 1} <= {r["doc_id"] for r in rows}, name
        if name == "secrets":
            secret = next(r for r in rows if r["doc_id"] == 10**9 + 2)
            assert secret["text"] == "[secret]" and secret["n_chars"] == 8
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_equals_a_brute_force_chain(spark):
    """The classifier's and the automata's decisions are taken from their operators; the rest is computed again."""
    import re

    import sentencepiece as lib

    from cohabit.llm import secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    sets = {}
    for i, t in kept.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i}

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for t in bench:
        w = re.findall(word, fold(t))
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    for i in list(kept):
        w, hit = re.findall(word, fold(kept[i])), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            del kept[i]

    rest = spark.createDataFrame(sorted(kept.items()), "doc_id long, text string")
    clean = {}
    for r in secrets.find(rest, secrets.fit(rest)).collect():
        t, at, out = r["text"], 0, ""
        for s in r["secret_spans"]:
            if s["start"] > at or at == 0:
                out += t[at : s["start"]] + "[secret]"
            at = max(at, s["end"])
        clean[r["doc_id"]] = None if t is None else out + t[at:]
    sp = lib.SentencePieceProcessor(model_file=corpus_pipeline.sentencepiece.MODEL_PATH)
    got = {r["doc_id"]: (r["text"], r["piece_ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: (t, None if t is None else sp.encode(t)) for i, t in clean.items()} and len(got) < docs.count()
