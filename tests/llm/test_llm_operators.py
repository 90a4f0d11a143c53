"""Every training-data operator against a brute-force version on small tables with awkward rows."""

import hashlib
import random
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vecspark.llm import (decontaminate, fm_index, langid, licenses, line_dedup, mixing, ngram_jaccard, sharding, token_records,
                          topk, trie, warc)
from vecspark.llm.catalog import ORACLE, QUERIES, vocabulary
from vecspark.llm.components import connected_components
from vecspark.session import scratch_path

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang]); an extra column whose name clashes with an output."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")).withColumn("N_words", F.lit(1))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps1", "zeta", "ETA", "theta"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(n) for n in (3, 5, 9, 12, 40, 60, 200)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base * 3):
        w = t.split()
        if i % 2 and len(w) > 6:
            w[rng.randrange(len(w))] = "new%d" % i
        rows.append((100 + i, " ".join(w) + ("\n" + say(4) if i % 3 == 0 else "")))
    rows += [(7, None), (8, ""), (9, " \t\n "), (None, base[4]), (None, None), (10, base[5]), (10, base[5]), (-3, base[6]),
             (11, "日本語 テキスト " * 30), (12, "x" * 70_000), (13, say(30_000))]
    return rows


# ---- 1 ----

def words1(t):
    return decontaminate.words_of(t)


def brute_hits(rows, items, size=10):
    out = []
    for d, t in rows:
        w, hit, names = words1(t), set(), set()
        for i, body in items:
            b = words1(body)
            for a in range(max(1, len(b) - size + 1) if b else 0):
                p = b[a:a + size]
                for k in range(len(w) - len(p) + 1):
                    if w[k:k + len(p)] == p:
                        hit.update(range(k, k + len(p)))
                        names.add(str(i))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_matches_brute_force(spark, texts):
    rows = [r for r in texts if not (r[1] and len(r[1]) > 60_000)]
    items = [(3, texts[5][1][10:150]), (4, "alpha beta"), (5, None), (6, ""), (7, "délta"), (8, texts[6][1]), (20, texts[6][1])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = brute_hits(rows, [x for x in items if x[1]])
    for block in (1 << 20, 40):
        got = decontaminate.contamination_digest(decontaminate.find_contamination(spark, docs_of(spark, rows), bench, block_bytes=block))
        assert sorted(map(tuple, got.collect()), key=str) == want
    empty = decontaminate.find_contamination(spark, docs_of(spark, rows), bench.limit(0))
    assert empty.where("size(items) > 0").count() == 0 and empty.count() == len(rows)
    assert decontaminate.find_contamination(spark, docs_of(spark, rows).limit(0), bench).count() == 0


def test_removed_spans_leave_the_rest(spark):
    text = "Keep this. " + " ".join("w%d" % i for i in range(12)) + " and that!"
    bench = spark.createDataFrame([(1, " ".join("W%d" % i for i in range(12)))], "item_id int, text string")
    out = decontaminate.remove_contamination(spark, docs_of(spark, [(1, text), (2, "clean text"), (3, None)]), bench)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "Keep this. \n\n and that!", 2: "clean text", 3: None}


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        text = np.append(rng.integers(0, 4, n), 0)
        index = fm_index.FMIndex(text)
        pats = [rng.integers(1, 5, k) for k in (1, 2, 3, 5) for _ in range(6)]
        table = np.full((len(pats), 5), -1)
        for i, p in enumerate(pats):
            table[i, :len(p)] = p
        lo, hi = index.find(table, np.array([len(p) for p in pats]))
        for p, a, b in zip(pats, lo, hi):
            want = [i for i in range(len(text) - len(p) + 1) if (text[i:i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---- 2 ----

def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=int(n)).round(2).tolist()) for i, n in zip(range(0, 400), rng.integers(0, 6, 400))]
    rows += [(500, None), (550, [None, 1.0]), (600, [float("nan")]), (650, [float("inf")]), (None, [1.0]), (700, rows[50][1]), (750, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for kw in ({}, {"query_block": 2, "group_rows": 3}):
        got = topk.exact_top_k(spark, df, F.col("vec_id") % 50 == 0, 5, **kw)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.exact_top_k(spark, df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.exact_top_k(spark, df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).count() == 1


# ---- 3 ----

def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    lab = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y) and lab[a] != lab[b]:
                lab = [lab[b] if k == lab[a] else k for k in lab]
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(rows)) if lab[j] == lab[k] and sets[j][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


def test_ngram_join_matches_brute_force(spark, texts, monkeypatch):
    rng = random.Random(9)
    rows = [r for r in texts if r[0] != 10] + [(10, texts[5][1])]
    words = ["w%d" % i for i in range(400)]
    for g in range(5):                                   # groups of near copies around a text, at many distances
        base = [rng.choice(words) for _ in range(80)]
        for c in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = "z%d" % rng.randrange(9)
            rows.append((1000 + 100 * g + c, " ".join(w)))
    want = brute_components(rows)
    for cell in (256, 4):                                # small cells: several rounds and the exact end
        monkeypatch.setattr(ngram_jaccard, "CELL_SETS", cell)
        got = ngram_jaccard.ngram_jaccard_join(spark, docs_of(spark, rows).repartition(3))
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert ngram_jaccard.ngram_jaccard_join(spark, docs_of(spark, rows).limit(0)).count() == 0


def test_trie_links_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 12))) for _ in range(60)]
    sizes = np.array([len(s) + int(rng.integers(0, 2)) for s in sets])
    lab, _ = trie.link_cell(sets, sizes, np.arange(60), np.arange(60), np.arange(60), 75, 100)
    want = np.arange(60)
    for a in range(60):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 75 * (sizes[a] + sizes[b] - o):
                want[want == max(want[a], want[b])] = min(want[a], want[b])
    assert [np.flatnonzero(lab == x)[0] for x in lab] == [np.flatnonzero(want == x)[0] for x in want]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(500, 500)]
    got = dict(map(tuple, connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(50)} == {100}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 4 ----

def test_token_records_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = texts + [(50, "two  spaces \n\n x's don't<|endoftext|> end "), (51, "² ½ª —   thin")]
    out = scratch_path(spark, "t-records")
    token_records.write_token_records(spark, docs_of(spark, rows), out, path)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    want, at = [], 0
    for i, t in sorted(rows, key=key):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for seed in (None, 3):
        got = token_records.token_digest(token_records.read_token_records(spark, out, seed)).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    rec = bytearray(token_records.frame(b"payload"))
    assert token_records.unframe(bytes(rec))[0] == b"payload"
    rec[14] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(bytes(rec))
    empty = scratch_path(spark, "t-records")
    token_records.write_token_records(spark, docs_of(spark, rows).limit(0), empty, path)
    assert token_records.read_token_records(spark, empty).count() == 0


# ---- 5 ----

def test_warc_round_trip_and_pushdown(spark):
    big, small = "<p>é" * 400, "<p>x"
    rows = [(1, "http://a/%7e x", big), (5, "http://b", big), (3, None, big), (2, "u\r\nv", small), (4, "u", small), (6, "n", None),
            (7, "e", ""), (None, "z", big), (8, "l", "y" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = scratch_path(spark, "t-warc")
    warc.write_warc(spark, df, path)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and h == big and i != 5
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert sorted(map(tuple, warc.warc_digest(spark, path).collect()), key=str) == sorted(want, key=str)
    one = warc.read_warc(spark, path).where("record_type = 'response' and page_id in (5, 6) and payload_bytes > 0")
    assert [(r["page_id"], r["payload"].decode()) for r in one.collect()] == [(5, big)]
    assert {r[0] for r in warc.read_warc(spark, path).select("target_uri").collect()} == {r[1] for r in rows}
    empty = scratch_path(spark, "t-warc")
    warc.write_warc(spark, df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_without_index_reads_the_same(tmp_path):
    import gzip

    recs = [warc.build_record(i, f"http://x/{i}", "2024-01-01T00:00:00Z", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    reader = warc.WarcReader(str(tmp_path), True)
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["page_id"], r["payload"]) for r in got] == [(i, b"p" * i) for i in range(4)]


# ---- 6 ----

def test_forward_sums_all_segmentations():
    pieces = langid.load_pieces(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    probs = rng.dirichlet(np.ones(len(pieces)), 2).T
    model = langid.Model(["a", "b"], pieces, probs)

    def brute(raw):
        if not raw:
            return np.ones(2)
        return sum((probs[pieces[raw[:m]]] * brute(raw[m:]) for m in range(1, len(raw) + 1) if raw[:m] in pieces), np.zeros(2))

    words = ["the", "a", "über", "nation"]
    want = [np.log(brute(langid._parts(w)[0])) for w in words]
    assert np.allclose(model.word_scores(words), want)


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_language_model(spark, docs, vocabulary("piece_bpe_32k.model"), train_texts=100)
    out = langid.predict_language(spark, docs, model).where(langid.held_out("doc_id"))
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.97 and 0 <= r[1] <= r[2] <= 1
    odd = langid.predict_language(spark, docs_of(spark, [(1, None), (2, ""), (3, "12 !? ²"), (None, "der und die")]), model)
    assert [x["lang_pred"] for x in odd.orderBy(F.expr("doc_id is null"), "doc_id").collect()] == ["und", "und", "und", "de"]
    none = langid.fit_language_model(spark, docs.limit(0), vocabulary("piece_bpe_32k.model"))
    assert {x["lang_pred"] for x in langid.predict_language(spark, docs.limit(5), none).collect()} == {"und"}


# ---- 7 ----

def test_license_scan_matches_plain_dice(spark, texts):
    mit, apache = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["Apache-2.0"][0]
    wrapped = "\n".join(textwrap.wrap(mit, 60))
    rows = [(1, "Intro text\n\n" + wrapped + "\n\nouttro"), (2, "line\n" + apache.upper() + "\nline"), (3, None), (4, ""),
            (5, "Released under the BSD terms of nobody"), (6, "GNU"), (7, "This work is licensed under the GNU General Public License, version 3!")]
    got = {r["doc_id"]: r for r in licenses.license_digest(licenses.scan_licenses(spark, docs_of(spark, rows + [(500 + k, t) for k, (_, t) in enumerate(texts)]))).collect()}
    assert [got[i]["license"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["MIT", "Apache-2.0", None, None, None, None, "GPL-3.0"]
    assert got[2]["dice"] == got[7]["dice"] == 1.0 and got[1]["dice"] > 0.9
    found = licenses.scan_licenses(spark, docs_of(spark, rows)).where("doc_id = 1").first()["licenses"]
    assert [(m["unit"], m["first_line"]) for m in found] == [("paragraph", 2)]


def test_licenses_inside_longer_texts(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    one, two = mit.index("The above"), mit.index("THE SOFTWARE IS")
    parts = "\n\n".join((mit[:one], mit[one:two], mit[two:]))
    prose = " ".join("plain%d words" % i for i in range(400))
    bsd3 = licenses.TEMPLATES["BSD-3-Clause"][0]
    rows = [(1, prose + "\n\nMIT License\n\n" + parts + "\n\n" + prose), (2, prose + " Released under the MIT License. " + prose),
            (3, "# " + "\n# ".join(textwrap.wrap(licenses.TEMPLATES["Zlib"][0], 70)) + "\n" + "x = call(y)\n" * 300),
            (4, prose + " released under the MIT press by " + prose), (5, "Licensed under the Apache License, Version 1.0 " + prose),
            (6, "Code\n" * 300 + bsd3 + "\n" + prose), (7, prose + " " + mit + " " + mit + " " + prose),
            (8, prose + " " + licenses.TEMPLATES["AGPL-3.0"][0] + " see it " + prose)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark, docs_of(spark, rows)).collect()}
    assert {i: [m["license"] for m in x] for i, x in got.items()} == {
        1: ["MIT"], 2: ["MIT"], 3: ["Zlib"], 4: [], 5: [], 6: ["BSD-3-Clause"], 7: ["MIT", "MIT"], 8: ["AGPL-3.0"]}
    assert (got[1][0]["first_line"], got[1][0]["last_line"], got[1][0]["dice"]) == (4, 8, 1.0)
    assert got[2][0]["unit"] == "words" and got[2][0]["dice"] == 1.0


# ---- 8 ----

def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(70, None), (71, "a\na\na\na\na\na"), (72, "\n\n\n\n"), (None, "a\nb\nc"), (73, "solo")]
    got = line_dedup.dedup_digest(line_dedup.dedup_lines(spark, docs_of(spark, rows))).collect()
    seen, want = {}, []
    for k, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        if t is None:
            want.append((i, 0, 0, None))
            continue
        lines, gone = t.split("\n"), set()
        for a in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[a:a + 3]), (k, a)) != (k, a):
                gone.update((a, a + 1, a + 2))
        kept = "\n".join(x for a, x in enumerate(lines) if a not in gone)
        want.append((i, len(lines), len(gone), hashlib.md5(kept.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(spark, docs_of(spark, rows).limit(0)).count() == 0


# ---- 9 ----

def test_permutation_is_one_and_has_an_inverse():
    for n in (1, 2, 3, 40, 1000, 4097):
        p = sharding.position(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.row_at(p, n, 7).tolist() == list(range(n))


def test_shards_are_even_gapless_and_reproducible(spark, texts):
    a = sharding.document_shards(spark, docs_of(spark, texts), 4).collect()
    b = sharding.document_shards(spark, docs_of(spark, texts).repartition(5), 4).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(texts)
    order = sorted((r for r in a), key=lambda r: r["row_no"])
    pos = sharding.position(np.arange(len(a)), len(a), 20240607)
    assert [(r["shard"], r["slot"]) for r in order] == [(p % 4, p // 4) for p in pos.tolist()]
    for s in range(4):
        slots = sorted(r["slot"] for r in a if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(a) // 4, -(-len(a) // 4))
    by_id = {r["doc_id"]: r for r in a}
    for i, t in texts:
        if i not in (None, 10):
            raw = (t or "").encode()
            assert (by_id[i]["size"], by_id[i]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert sharding.document_shards(spark, docs_of(spark, texts).limit(0)).count() == 0


# ---- 10 ----

def test_rates_meet_reachable_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = mixing.mix_to_targets(spark, docs, labels, mixing.label_domain(), {"good": 0.7, "poor": 0.27, "toxic": 0.03})
    rows = out.select("doc_id", "n_tokens", "posterior", "rate", "copies").collect()
    n = np.array([r["n_tokens"] for r in rows], float)
    p, w = np.array([r["posterior"] for r in rows]), np.array([r["rate"] for r in rows])
    assert (w >= 0).all() and len(rows) == 1000
    assert np.abs((n * w) @ p - n.sum() * np.array([0.7, 0.27, 0.03])).max() <= 1e-3 * n.sum()
    toxic = {r[0] for r in labels.where("toxic = 1").select("doc_id").collect()}
    hit = [r["posterior"][2] > 0.5 for r in rows if r["doc_id"] in toxic]
    assert np.mean(hit) > 0.8
    odd = mixing.mix_to_targets(spark, docs_of(spark, [(1, None), (None, ""), (2, "a b")]), labels.limit(0), mixing.label_domain(),
                                {"good": 0.5, "toxic": 0.5})
    assert [r["copies"] for r in odd.collect()] == [1, 1, 1]


def test_copies_meet_the_targets_in_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    mix = lambda d: mixing.mix_to_targets(spark, d, labels, mixing.label_domain(), {"good": 0.7, "poor": 0.27, "toxic": 0.03})
    rows = mix(docs).select("doc_id", "n_tokens", "posterior", "rate", "copies").collect()
    n, c = np.array([r["n_tokens"] for r in rows], float), np.array([r["copies"] for r in rows])
    p, w = np.array([r["posterior"] for r in rows]), np.array([r["rate"] for r in rows])
    assert (np.floor(w) <= c).all() and (c <= np.floor(w) + 1).all()
    assert np.abs((n * c) @ p / n.sum() - [0.7, 0.27, 0.03]).max() < 0.02
    same = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("all the same words").alias("text"))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "copies").collect()))
    thin = lambda d: mixing.mix_to_targets(spark, d, labels.limit(0), mixing.label_domain(), {"good": 0.35, "poor": 0.35})
    one = key(thin(same))
    assert one == key(thin(same.repartition(7))) and 240 < sum(x for _, x in one) < 320      # equal rows share the fraction


def test_toxic_documents_go_at_any_share(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(8)
    say = lambda n: " ".join("w%d" % rng.randrange(300) for _ in range(n))
    for share, words in ((0.001, 1000), (0.01, 100), (0.1, 9)):       # 30 toxic documents of 10 words, 300 clean ones
        rows = [(i, say(words) + (" fine" if i % 3 else " meh")) for i in range(300)]
        rows += [(1000 + i, "foul slur " + say(8)) for i in range(30)]
        n = [len(t.split()) for _, t in rows]
        assert abs(sum(n[300:]) / sum(n) - share) < 0.1 * share
        d = str(tmp_path / str(words))
        spark.createDataFrame([(i, int(i % 3 > 0), int(i >= 1000)) for i, _ in rows if i % 5], "doc_id long, quality int, toxic int"
                              ).write.parquet(f"{d}/labels.parquet")
        got = sorted(r[0] for r in cp.mixing_stage(spark, docs_of(spark, rows), d).select("doc_id").collect())
        assert got == list(range(300))                                # every toxic one goes, every clean one stays once
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{d}/none/labels.parquet")
    assert cp.mixing_stage(spark, docs_of(spark, rows), f"{d}/none").count() == len(rows)


# ---- queries ----

@pytest.fixture(scope="module")
def small_duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, small_duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    small_duck.execute(f"CREATE OR REPLACE VIEW v AS {ORACLE[name]}")
    want = small_duck.sql("SELECT * FROM v").df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(str([None if str(x) in ("nan", "None", "<NA>") else (x if isinstance(x, (str, bool, np.bool_)) else float(x))
                                 for x in r]) for r in d[cols].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_one_row_of_a_group_stays(spark):
    import corpus_pipeline as cp

    a, b, c, d, e = ("one two three four five six %s" % x for x in "abcde")
    a, b, c, d, e = (t + " " + " ".join(t[-1] + str(i) for i in range(40)) for t in (a, b, c, d, e))
    rows = [(3, a), (7, a), (7, b), (9, b),                    # an id with two texts, one of them linked to a lesser id
            (20, c), (20, c), (20, c),                         # repeated rows
            (None, d), (None, d), (None, d + " end"),          # a group without ids, near copies too
            (None, e), (30, e), (40, None), (None, ""), (41, "")]
    got = cp.near_duplicates(spark, docs_of(spark, rows), SMALL)
    assert got.columns == docs_of(spark, rows).columns
    kept = [(r[0], r[1]) for r in got.select("doc_id", "text").collect()]
    ends = [x for x in kept if x[1] and x[1].startswith(d)]
    assert len(ends) == 1 and ends[0][0] is None
    assert sorted((x for x in kept if x not in ends), key=str) == sorted(
        [(3, a), (7, b), (20, c), (30, e), (40, None), (None, ""), (41, "")], key=str)


def test_pipeline_stages_do_their_work(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.limit(1).withColumn("doc_id", F.lit(9001).cast("long")).withColumn("text", F.lit("1234 !!"))
    kept = cp.language_id(spark, docs.unionByName(extra), SMALL)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    groups = brute_components([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    one = cp.near_duplicates(spark, docs, SMALL)
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(i for i, _, c in groups if i == c)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    clean = cp.decontamination(spark, docs, SMALL)
    assert clean.columns == docs.columns
    again = decontaminate.find_contamination(spark, clean, bench)
    assert again.where("size(items) > 0").count() == 0
    assert clean.where("n_chars != char_length(text)").count() == 0
    out = QUERIES["pipeline"](spark, SMALL)
    assert {"shard", "slot", *docs.columns} <= set(out.columns)
    final = [r for r in out.select("doc_id", "shard", "slot").collect()]
    pos = sorted(r["slot"] * cp.SHARDS + r["shard"] for r in final)
    assert pos == list(range(len(final))) and {r["doc_id"] for r in final} <= {r[0] for r in one.select("doc_id").collect()}
