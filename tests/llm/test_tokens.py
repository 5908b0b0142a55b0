"""Operators 11 to 13 against brute force: Merkle manifests, byte-level BPE, alignment of two tokenizers."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohabit.llm import align, bpe, merkle, pairindex, queries, sentencepiece

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", " \n ", "'s", " 's", "\n's", "x'll've're'S", "''s", "'sabc 'relax", "a  b\t\tc \n d", "日本語 テスト", "é ü ñ　ß", "😀😀 x", "1234 5678x9", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
    "ends in <|endof", "text|> begins", "  <|endoftext|>  ", "▁ low line ▁", "<s> <0x41> </s>", "==== ---- ____", "x" * 50_000, "ab" * 20_000 + " " * 3_000, "\x1c\x85\x00 control", "the same row", "the same row",
]


def noise(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]


def texts():
    return [*ODD, *noise(1, 400, [*"aab bcst'm  \n\t12é日 .,-!?rveld<|>▁=_", "'s", "'re", "<|endoftext|>", "the", "tion"])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(rows)], "doc_id long, text string, `a.b` string, n_links int")


def of_library(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.MODEL_PATH)
    t.encode_special_tokens = not special
    return t


def test_bpe_equals_the_library_and_decodes(spark):
    rows = texts()
    coder, lib = bpe.load(), of_library(True)
    df = frame(spark, rows).withColumn("IDS", F.lit("goes"))
    coded = bpe.encode(df, coder, decoded_to="back")
    assert coded.columns == ["doc_id", "text", "a.b", "n_links", "ids", "back"]
    got = bpe.decode(coded, coder).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r["doc_id"]]
        want = None if t is None else lib.encode(t, add_special_tokens=False).ids
        assert r["ids"] == want and r["back"] == r["decoded"] == t and r["a.b"] == "clash"
    plain, lib = bpe.encode(df, coder, special=False).collect(), of_library(False)
    assert all(r["ids"] == (None if r["text"] is None else lib.encode(r["text"], add_special_tokens=False).ids) for r in plain)
    assert bpe.encode(df.limit(0), coder).count() == 0
    broken = spark.createDataFrame([([0xE9, None, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(broken, coder).collect()] == [coder.token_bytes[0xE9].decode(errors="replace"), None, ""]


def test_words_forgotten_by_a_task_are_found_again(monkeypatch):
    monkeypatch.setattr(bpe, "HELD_WORDS", 20)
    encoder, lib = bpe.Encoder(bpe.load()), of_library(True)
    rows = [t for t in texts() if t is not None and len(t) < 1000]
    for lo in range(0, len(rows), 30):
        part = [rows[lo : lo + 10], rows[lo + 10 : lo + 30]]
        for some, (ids, at) in zip(part, encoder.encode(part), strict=True):
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in some]


def one_by_one(word, pairs):
    """The merges of one word: lowest rank first, then leftmost."""
    word = list(word)
    while True:
        found = [(pairs[a, b][0], i) for i, (a, b) in enumerate(zip(word[:-1], word[1:], strict=True)) if (a, b) in pairs]
        if not found:
            return word
        _, i = min(found)
        word[i : i + 2] = [pairs[word[i], word[i + 1]][1]]


def test_pair_index_equals_merging_words_one_by_one():
    rng = random.Random(9)
    for trial in range(60):
        pairs, symbols = {}, list(range(4))
        for k in range(25):
            a, b = rng.choice(symbols), rng.choice(symbols)
            # also pairs that rank before what makes their sides, and several pairs of one rank
            pairs.setdefault((a, b), (rng.randrange(20) if trial % 2 else k, len(symbols)))
            symbols.append(len(symbols))
        merges = pairindex.Merges.build((a, b, r, m) for (a, b), (r, m) in pairs.items())
        words = [[rng.randrange(4) for _ in range(rng.choice([0, 1, 2, 5, 60]))] for _ in range(150)] + [[0] * 200]
        at = np.cumsum([0, *map(len, words)])
        got, began = pairindex.PairIndex(merges).merge(np.array([s for w in words for s in w], dtype=np.int64), at)
        ends = np.searchsorted(began, at)
        assert [got[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [one_by_one(w, pairs) for w in words]


def piece_library():
    import sentencepiece as lib

    return lib.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)


def test_piece_encoder_equals_the_library():
    rows = texts()
    encoder, lib = align.PieceEncoder(align.piece_bpe(sentencepiece.load())), piece_library()
    for ids, at in encoder.encode([rows]):
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [lib.encode(t or "") for t in rows]


def brute_alignment(rows):
    """(n_a, n_b, groups) of each text, and its links, by walking over both token sequences."""
    a_lib, b_lib, coder = of_library(False), piece_library(), bpe.load()
    b_bytes = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for t in rows:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        if not t or b"".join(map(b_bytes, b)) != (" " + t).encode():
            out.append((0, 0, [], []))
            continue
        groups, i, j, x, y = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x += len(coder.token_bytes[a[i]])
                groups[-1][0].append(a[i])
                i += 1
            else:
                y += len(b_bytes(b[j]))
                groups[-1][1].append(b[j])
                j += 1
            if x == y:
                groups.append(([], []))
        out.append((len(a), len(b), groups[:-1], [(p[-1], q[-1]) for p, q in groups[:-1]]))
    counts = Counter(link for *_, links in out for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    show = lambda groups: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
    return [(n_a, n_b, len(g), show(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)) for n_a, n_b, g, links in out]


@pytest.mark.parametrize("common", [align.COMMON, 3])
def test_alignment_brute_force(spark, common):
    rows = texts() + ["naïve café brûlée", "one two  three", "Straße 12345", "x = y;  // z"] * 3
    found = align.align(frame(spark, rows), bpe.load(), sentencepiece.load(), common=common)
    assert found.columns == ["doc_id", "text", "a.b", *align.OWN]
    got = {r["doc_id"]: tuple(r[c] for c in align.OWN) for r in found.collect()}
    want = dict(enumerate(brute_alignment(rows)))
    assert got == want and sum(x[0] == 0 for x in want.values()) > 4
    empty = align.align(frame(spark, rows).limit(0), bpe.load(), sentencepiece.load())
    assert empty.count() == 0 and empty.columns == found.columns


def test_most_links_of_prose_take_the_identity_map(spark):
    links = align.aligned(frame(spark, ["The quick brown fox, of course, was seen at the river and in the town."] * 4), bpe.load(), sentencepiece.load())
    exact = sum(r["n"] for r in align.exact_counts(links, 50257).collect())
    odd = sum(r["n"] for r in align.odd_counts(links).collect())
    assert exact + odd == sum(r["n_groups"] for r in links.collect()) and exact > 4 * odd


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes, fanout):
    """Root, and the proof (siblings before and after, level by level) of each node."""
    proofs, paths = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(paths):
            lo = at // fanout * fanout
            proofs[i].append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + fanout])))
            paths[i] = at // fanout
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], proofs


@pytest.mark.parametrize(("fanout", "levels"), [(2, 3), (2, 1), (3, 2)])
def test_manifest_brute_force(spark, fanout, levels):
    rng = random.Random(fanout)
    rows = [(i if rng.random() < 0.95 else None, rng.choice(["en", "en", "en", None, "", "dé"]), rng.choice([None, "", "text " * rng.randint(1, 9)])) for i in range(140)]
    rows += [(900, "lone", "x"), (5, "en", "repeated"), (5, "en", "repeated"), (5, "en", "repeated")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    leaves = df.select("doc_id", "lang", merkle.leaf(F.col("doc_id"), F.col("lang"), F.col("text")).alias("leaf"), F.lit("clash").alias("root"), F.col("text").alias("a.b"))
    found = merkle.manifest(leaves, "lang", "doc_id", fanout=fanout, levels=levels)
    assert found.columns == ["doc_id", "lang", "leaf", "a.b", "subroot", "root", "proof"]
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for i, lang, text in rows:
        by[lang].append(((i is not None, i or 0), h(show(i), show(lang), show(text))))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: brute_tree([leaf for _, leaf in sorted(by[lang])], fanout) for lang in langs}
    root, tops = brute_tree([trees[lang][0] for lang in langs], fanout)
    want = Counter((leaf, trees[lang][0], root, tuple(proof + tops[k])) for k, lang in enumerate(langs) for (_, leaf), proof in zip(sorted(by[lang]), trees[lang][1], strict=True))
    got = found.collect()
    assert Counter((r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in got) == want
    checked = found.select(merkle.folded(F.col("leaf"), F.col("proof")).alias("f"), merkle.folded(F.lit(h("other")), F.col("proof")).alias("g"), "root").collect()
    assert all(r["f"] == r["root"] != r["g"] for r in checked)
    assert merkle.manifest(leaves.limit(0), "lang", "doc_id").count() == 0
    one = merkle.manifest(leaves.where("lang = 'lone'"), "lang", "doc_id").first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_token_queries(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lib, sha = of_library(True), lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.op12_bpe(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        ids = lib.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    keys = sorted(docs)
    want = dict(zip(keys, brute_alignment([docs[k] for k in keys]), strict=True))
    for r in queries.op13_align(spark, SF).collect():
        n_a, n_b, n_groups, groups, n_links, n_best, count_sum = want.pop(r["doc_id"])
        assert tuple(r)[1:] == (n_a, n_b, n_groups, n_links, n_best, count_sum, sha(groups) if groups else "")
    assert not want
