"""Exact weights, second writes to one path, foreign URIs, and input columns named like the operators' own."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecspark.llm import line_dedup, mixing, sharding, token_records, topk, warc
from vecspark.llm.catalog import vocabulary
from vecspark.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def ranked(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return [tuple(r) for r in topk.exact_top_k(spark, df, F.col("vec_id") % 50 == 0, k).collect()]


def test_large_components_keep_their_order(spark):
    rows = [(0, [1.0, 2.0]), (1, [600_000.0, 0.0]), (2, [700_000.0, 0.0]), (3, [-9e9, 0.5]), (4, [2.0 ** 31 / 256, -2.0 ** 31 / 256]),
            (5, [(2.0 ** 32 - 1) / 256, 0.0]), (50, [1e3, -1e3]), (7, [])]
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        best = sorted((-sum(x * y for x, y in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(ranked(spark, rows)) == sorted(want)


def test_sums_beyond_the_range_on_the_way_are_exact(spark):
    big = 2.0 ** 31 / 256                                   # each product is 2^62
    rows = [(0, [big] * 4), (1, [big, big, -big, -big]), (2, [big, big, -big, 0.0])]
    want = [(0, 1, 2, 1 << 62), (0, 2, 1, 0)]
    assert sorted(ranked(spark, rows)) == want


@pytest.mark.parametrize("rows", [[(0, [2.0 ** 40]), (1, [2.0 ** 40])], [(0, [1.0]), (1, [1e300])]])
def test_scores_beyond_64_bits_fail(spark, rows):
    with pytest.raises(Exception, match="64 bits|2\\^62"):
        ranked(spark, rows)


def test_second_writes_of_token_records(spark):
    path, vocab = scratch_path(spark, "t-records"), vocabulary("byte_bpe_50k.json")
    one, two = (spark.createDataFrame(r, "doc_id long, text string") for r in ([(1, "one two"), (5, "five")], [(3, "three"), (2, None)]))
    token_records.write_token_records(spark, one, path, vocab)
    first = [tuple(r) for r in token_records.read_token_records(spark, path).orderBy("start").collect()]
    token_records.write_token_records(spark, two, path, vocab)
    both = [tuple(r) for r in token_records.read_token_records(spark, path).orderBy("start").collect()]
    assert both[:2] == first and [r[0] for r in both] == [1, 5, 2, 3]
    assert [r[1] for r in both] == np.cumsum([0] + [r[2] for r in both[:-1]]).tolist()
    token_records.write_token_records(spark, two, path, vocab, mode="overwrite")
    assert sorted(r[0] for r in token_records.read_token_records(spark, path).collect()) == [2, 3]


def test_second_writes_of_archives(spark):
    path = scratch_path(spark, "t-warc")
    page = lambda i: spark.createDataFrame([(i, f"http://a/{i}", "<p>x")], "page_id long, url string, html string")
    for i in (1, 2):
        warc.write_warc(spark, page(i), path)
    assert sorted(r[0] for r in warc.read_warc(spark, path).select("page_id").collect()) == [1, 2]
    warc.write_warc(spark, page(3), path, mode="overwrite")
    assert [r[0] for r in warc.read_warc(spark, path).select("page_id").collect()] == [3]


def test_archives_answer_several_queries(spark):
    path = scratch_path(spark, "t-warc")
    pages = spark.createDataFrame([(i, None, "<p>" * 500 if i < 3 else f"{i}") for i in range(9)], "page_id long, url string, html string")
    warc.write_warc(spark, pages, path)
    records = warc.read_warc(spark, path)
    assert [records.where("record_type = 'revisit'").count(), records.count(), records.where("page_id > 6").count()] == [2, 9, 2]
    assert records.where("length(payload) > 100 or page_id = 8").count() == 2 and records.select("page_id").distinct().count() == 9


def test_escapes_of_other_writers_stay(tmp_path):
    raw = hashlib.sha1(b"p").hexdigest()
    own = warc.build_record(1, "http://a/x%20y z", "2024-01-01T00:00:00Z", b"p", raw, None)
    plain = warc.build_record(2, "http://a/x", "2024-01-01T00:00:00Z", b"p", raw, None)
    other = plain.replace(b"http://a/x\r\n", b"http://a/x%20y%2Fz\r\n")
    uri = lambda rec: warc.parse_headers(rec.split(b"\r\n\r\n")[0])["target_uri"]
    assert [uri(r) for r in (own, plain, other)] == ["http://a/x%20y z", "http://a/x", "http://a/x%20y%2Fz"]


def clashing(spark, rows, names):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])


def kept(out, names):
    return all(r[n] == f"{n}{r['doc_id']}" for r in out.select("doc_id", *names).collect() for n in names)


def test_operators_pass_clashing_columns_through(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\ne"), (3, "a\nb\nc\nd"), (4, None)]
    names = ["__id", "__th", "__starts", "_th", "id"]
    out = line_dedup.dedup_lines(spark, clashing(spark, rows, names))
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_removed"] and kept(out, names)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "a\nb\nc\nd"), (2, "e"), (3, ""), (4, None)]
    names = ["__part", "__AT"]
    out = sharding.shuffle_into_shards(spark, clashing(spark, rows, names), 3, [F.asc("doc_id")])
    assert out.columns[:4] == ["doc_id", "text", *names] and kept(out, names)
    names = ["__key", "__number"]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix_to_targets(spark, clashing(spark, rows + rows[:1], names), labels, mixing.label_domain(), {"good": .5, "poor": .5})
    assert out.count() == 5 and kept(out, names)


def test_pipeline_stages_keep_the_columns_of_the_input(spark):
    import corpus_pipeline as cp

    own = ["score", "lang_pred", "n_words", "spans", "items", "rate", "copies", "posterior", "__id", "__hash", "__one", "__nth", "__copy",
           "text_hash", "component", "quality", "input_3"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").drop("n_chars")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in own], F.create_map("source", "doc_id").alias("m"))
    docs = docs.unionByName(docs.where("doc_id < 3"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.count() > 0 and kept(out, own), name


def test_mixing_stage_brings_poor_text_to_its_share(spark, tmp_path):
    import random

    import corpus_pipeline as cp

    rng = random.Random(4)
    say = lambda word: word + " " + " ".join("w%d" % rng.randrange(200) for _ in range(19))
    rows = [(i, say("fine fair")) for i in range(500)] + [(1000 + i, say("meh dull")) for i in range(40)] + [(2000 + i, say("foul slur")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(i, int(i < 1000), int(i >= 2000)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    n = {r["doc_id"]: r["count"] for r in cp.mixing_stage(spark, docs, str(tmp_path)).groupBy("doc_id").count().collect()}
    assert set(range(500)) <= set(n) and set(n) <= set(range(500)) | set(range(1000, 1040))      # no good document goes, every toxic one does
    poor = sum(c for i, c in n.items() if i >= 1000)
    assert abs(poor - cp.TARGETS["poor"] * len(rows)) < 0.15 * cp.TARGETS["poor"] * len(rows)    # 114 copies of 40 documents, in expectation


def test_encoder_cuts_columns_as_the_library_does():
    import random

    import numpy as np
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = token_records.Encoder(f.read())
    bits = ["'", "'s", "'re", "'ll", "'S", " ", "  ", "\n", "\t", "a", "Z", "é", "12", "²", ".", "–", "€", "日本", " ", "<|endoftext|>", "word", " the", "s", "l"]
    draw = random.Random(5)
    texts = [None, "", "'", " ", "l'", "s"] + ["".join(draw.choices(bits[:16 + 8 * (i % 2)], k=draw.randint(0, 20))) for i in range(600)]
    for size in (1, 250):                               # a cut, a contraction or a run of spaces ends with its text
        for i in range(0, len(texts), size):
            part = texts[i:i + size]
            ids, cut = enc.encode_column(pa.array(part, pa.string()))
            want = [e.ids for e in enc.tok.encode_batch([t or "" for t in part], add_special_tokens=False)]
            assert [x.tolist() for x in np.split(ids, cut[1:-1])] == want


def test_small_tables_of_the_jaccard_join_are_few_files(spark, monkeypatch):
    from vecspark.llm import ngram_jaccard, storage

    paths, place = [], storage.scratch_path
    monkeypatch.setattr(storage, "scratch_path", lambda spark, name: paths.append(place(spark, name)) or paths[-1])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 96)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = [" ".join(f"w{(i // 4) * 40 + j}" for j in range(40)) + " end" * (i % 4) for i in range(80)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard_join(spark, docs).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: i // 4 * 4 for i in range(80)}
    most = 2 * spark.sparkContext.defaultParallelism
    files = {p: spark.read.parquet(p).inputFiles() for p in paths if "/nj-docs-" not in p}
    assert len(files) > 10 and all(len(f) <= most for f in files.values())


def test_mixture_meets_every_bound(spark, tmp_path):
    """Shares are of the mixture that comes out, and every named domain keeps its bound, not poor text alone."""
    import random

    import numpy as np

    import corpus_pipeline as cp

    rng = random.Random(4)
    say = lambda word: word + " " + " ".join("w%d" % rng.randrange(200) for _ in range(19))
    rows = [(i, say("fine fair")) for i in range(500)] + [(1000 + i, say("meh dull")) for i in range(40)] + [(2000 + i, say("foul slur")) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), int(i >= 2000)) for i, _ in rows], "doc_id long, quality int, toxic int")
    out = mixing.mix_to_targets(spark, docs, labels, mixing.label_domain(), cp.TARGETS, leave_out=cp.LEAVE_OUT, at_least=cp.AT_LEAST).collect()
    n, w, p = (np.array([r[c] for r in out], float) for c in ("n_tokens", "rate", "posterior"))
    good, poor, toxic = (n * w) @ p
    size = good + poor + toxic
    stay = p[:, 2] <= cp.LEAVE_OUT["toxic"]
    assert (w[~stay] == 0).all() and good >= (n[stay] @ p[stay])[0] - 1e-3 * size
    assert abs(poor / size - cp.TARGETS["poor"]) < 1e-3 and toxic / size <= cp.TARGETS["toxic"] + 1e-3


def test_bounds_hold_each_other(spark):
    import numpy as np

    def totals(rows, steps):
        n, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
        return (n * mixing.rates_of(p, steps)) @ p

    # less of domain 2 takes of domain 0, which must be brought back by other documents
    rows = [(10, [.8, .0, .2])] * 50 + [(10, [.5, .5, .0])] * 50 + [(10, [1.0, .0, .0])] * 50
    features = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    goal = np.full(3, np.nan)
    now, got = totals(rows, []), totals(rows, mixing.fit_bounded(features, goal, {0: None, 1: .19}, {2: .01}))
    size = got.sum()
    assert got[0] >= now[0] - 1e-3 * size and got[1] >= max(now[1], .19 * size) - 1e-3 * size and got[2] <= (.01 + 1e-3) * size
    # nothing is broken, nothing is moved
    assert mixing.fit_bounded(features, goal, {0: None, 1: .1}, {2: .3}) == []
    # no text has enough of domain 1: rates stay as they are
    thin = spark.createDataFrame([(10, [.99, .01, .0])] * 50, "n_tokens long, posterior array<double>")
    assert mixing.fit_bounded(thin, goal, {0: None, 1: .19}, {2: .01}) == []
    # of a given total
    got = totals(rows, mixing.fit_bounded(features, goal, {1: .5}, {}, total=2000.0))
    assert abs(got[1] - 1000) < 1
