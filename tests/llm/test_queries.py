"""Every opN query on the smallest tables: against its SQL, or against a brute-force version."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from cohabit.llm import queries, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    df, sql = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect()))) == sorted(map(str, sql.select(*[duckdb.ColumnExpression(c) for c in sorted(df.columns)]).fetchall()))


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


def test_quality_query(spark, duck, texts):
    rows = queries.op2_quality(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels, score = dict(duck.sql("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall()), {r["doc_id"]: r["score"] for r in rows}
    pairs = [(score[a], score[b]) for a in labels for b in labels if labels[a] == 1 and labels[b] == 0]
    assert sum(a > b for a, b in pairs) > 0.9 * len(pairs)


def best_path(text, score, longest=16):
    """Number of pieces of the best sum of scores; of equal sums the one of the fewest pieces."""
    best = [(0.0, 0)]
    for j in range(1, len(text) + 1):
        best.append(max((best[i][0] + score[text[i:j]], best[i][1] - 1) for i in range(max(0, j - longest), j) if text[i:j] in score))
    return -best[-1][1]


def test_sentencepiece_query(spark, texts):
    import sentencepiece as lib

    sp = lib.SentencePieceProcessor(model_file=queries.sentencepiece.MODEL_PATH)
    rows = queries.op4_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["piece_ids"] == (None if t is None else sp.encode(t)) and r["round_trip"] and (t is None or r["n_pieces"] == len(r["piece_ids"]))
    # the Viterbi paths, by a dynamic program of the test's own over whole texts of the shorter documents
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    short = [r for r in rows if texts[r["doc_id"]] and len(texts[r["doc_id"]]) < 3000 and all(c in score for c in texts[r["doc_id"]].replace(" ", "▁"))][:60]
    assert len(short) > 20 and all(r["n_viterbi"] == best_path("▁" + texts[r["doc_id"]].replace(" ", "▁"), score) for r in short)
    assert any(r["n_viterbi"] != r["n_pieces"] for r in short)


def test_jaccard_query(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_jaccard(spark, SF).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_sharding_query(spark, texts):
    rows = queries.op6_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    shards, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append(r)
        groups[raw].add(r["shard"])
    assert set(shards) <= set(range(24)) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    assert all(len(g) == 1 for g in groups.values())
    sums = [sum(r["size"] for r in shards[k]) for k in range(24)]
    assert max(sums) - min(sums) <= max(r["size"] for r in rows)


def test_secrets_query(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for r in queries.op8_secrets(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        base = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        base.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        told = [":".join(map(str, s)) for s in base]
        assert [r[f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(s[0] == k for s in base) for k in secrets.KINDS[:3]]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(r["spans"].split(","))  | {""}
