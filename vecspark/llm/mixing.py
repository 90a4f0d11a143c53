"""Mixing by soft membership: document rates whose expected domain token totals match targets.

A classifier learned from the labelled table gives each document a posterior
over domains.  With token counts n_i and posteriors P_i, nonnegative rates w_i
minimise the squared difference between sum_i w_i n_i P_i and the targets, by
projected gradient from w = 1 (all documents once).  The table stays
distributed: an iteration sums one vector of domain totals, and as every step
is a function of the posterior and the few step vectors so far, rates are
recomputed from those instead of being stored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import tidy, tidy_group, unused, write_table
from .words import ALNUM, word_hashes

#: hashed word features
FEATURES = 1 << 18
#: labelled documents the classifier is fitted on, at most
TRAIN_ROWS = 8192
#: rounds of the classifier's and the rates' descent
FIT_ROUNDS = 150
MIX_ROUNDS = 60
TOLERANCE = 1e-6
#: fits until no bound is broken, at most, and the share of the tokens by which one may be
BOUND_ROUNDS = 12
BOUND_TOLERANCE = 1e-4
#: seed of the hash that decides on a rate's fraction
COPY_SEED = 20240607
#: step, weight decay and least documents of a feature (fewer in small samples) of the classifier
STEP = 10.0
DECAY = 1e-6
LEAST_DOCUMENTS = 8


# ---- domain classifier ------------------------------------------------------------------------------

def _features(texts: pa.Array):
    """For runs of texts: (words per text, distinct hashed features per text as (text, feature))."""
    for i, j, counts, words in word_hashes(texts, ALNUM):
        doc = np.repeat(np.arange(j - i, dtype=np.uint64), counts)
        key = np.unique((doc << np.uint64(18)) | (words & np.uint64(FEATURES - 1)))
        yield i, j, counts, (key >> np.uint64(18)).astype(np.int64), (key & np.uint64(FEATURES - 1)).astype(np.int64)


def _sample_rows(batches):
    """(domain, text) -> (one, domain, features)."""
    for rb in batches:
        for i, j, _, doc, feat in _features(rb.column(1)):
            cut = np.searchsorted(doc, np.arange(1, j - i))
            rows = [f.astype("<i4").tobytes() for f in np.split(feat, cut)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(j - i, np.int32)), rb.column(0).slice(i, j - i),
                                              pa.array(rows, pa.binary())], names=["one", "domain", "features"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(label: np.ndarray, doc: np.ndarray, feat: np.ndarray, classes: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights [feature, class] of a multinomial logistic model on 0/1 features; the last row is the bias."""
    n = len(label)
    often = np.bincount(feat, minlength=FEATURES)[feat] >= max(1, min(LEAST_DOCUMENTS, n // 500))
    doc, feat = doc[often], feat[often]
    used, col = np.unique(feat, return_inverse=True)
    w, pace = np.zeros((len(used), classes)), np.zeros((len(used), classes))
    bias = np.log((np.bincount(label, minlength=classes) + 1.0) / (n + classes))
    onehot = np.eye(classes)[label]
    for _ in range(rounds):                                 # full batch, with momentum: frequent features move first
        z = np.stack([np.bincount(doc, w[col, c], minlength=n) for c in range(classes)], axis=1) + bias
        err = (_softmax(z) - onehot) / n
        grad = np.stack([np.bincount(col, err[doc, c], minlength=len(used)) for c in range(classes)], axis=1) + DECAY * w
        pace = 0.9 * pace + grad
        w -= STEP * pace
        bias -= 0.5 * err.sum(axis=0)
    out = np.zeros((FEATURES + 1, classes))
    out[used] = w
    out[-1] = bias
    return out


def _train(classes: int):
    def run(t: pa.Table) -> pa.Table:
        label = t["domain"].to_numpy().astype(np.int64)
        rows = [np.frombuffer(x.as_py(), "<i4") for x in t["features"]]
        order = sorted(range(len(rows)), key=lambda i: (int(label[i]), rows[i].tobytes()))    # whatever order rows came in
        label, rows = label[order], [rows[i] for i in order]
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        w = fit_softmax(label, doc, np.concatenate(rows).astype(np.int64), classes)
        return pa.table({"weights": pa.array([w.astype("<f4").tobytes()], pa.binary())})
    return run


def fit_domains(spark: SparkSession, docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], *,
                text: str = "text", doc_id: str = "doc_id", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Classifier weights from at most ``train_rows`` labelled documents (chosen by hashed id).

    ``domain``: the name of a labelled row's domain (a column over ``labels``),
    null where it has none; names outside ``domains`` count as null.  Without
    any usable row the weights are zero: all posteriors are equal.
    """
    number = F.coalesce(*[F.when(domain == name, F.lit(i)) for i, name in enumerate(domains)])
    known = labels.select(F.col(doc_id).alias("id"), number.alias("domain")).where("id is not null and domain is not null")
    known = known.groupBy("id").agg(F.min("domain").alias("domain"))
    n = known.count()
    if not n:
        return np.zeros((FEATURES + 1, len(domains)))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit("domains")), 11).cast("double") / float(1 << 53)
    some = known.where(u < 0.9 * train_rows / n).limit(train_rows)
    rows = (docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
            .join(F.broadcast(some), "id").select("domain", "text"))
    got = (rows.mapInArrow(tidy(_sample_rows), "one int, domain int, features binary").groupBy("one")
           .applyInArrow(tidy_group(_train(len(domains))), "weights binary").collect())
    if not got:
        return np.zeros((FEATURES + 1, len(domains)))
    return np.frombuffer(got[0][0], "<f4").reshape(FEATURES + 1, len(domains)).astype(float)


def _posteriors(weights, text_col: str):
    def run(batches):
        w = weights.value
        for rb in batches:
            n_words, post = [np.zeros(0, np.int64)], [np.zeros((0, w.shape[1]))]
            for i, j, counts, doc, feat in _features(rb.column(rb.schema.get_field_index(text_col))):
                z = np.stack([np.bincount(doc, w[feat, c], minlength=j - i) for c in range(w.shape[1])], axis=1) + w[-1]
                n_words.append(counts)
                post.append(_softmax(z))
            post = np.concatenate(post)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(post.reshape(-1)), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(np.concatenate(n_words), pa.int64()), flat],
                                             names=[*rb.schema.names, "n_tokens", "posterior"])
    return run


# ---- rates ------------------------------------------------------------------------------------------

def rates_of(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps so far, from rate 1."""
    w = np.ones(len(posterior))
    for s in steps:
        w = np.maximum(0.0, w - posterior @ s)
    return w


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _moments(d: int, steps: list[np.ndarray]):
    """Per batch: the sum of w n P, and of n P P' over documents whose rate is above 0 and over all."""
    def run(batches):
        for rb in batches:
            n, p = rb.column(0).to_numpy().astype(float), _matrix(rb.column(1), d)
            w = rates_of(p, steps)
            outer = [((p * (n * on)[:, None]).T @ p).reshape(-1) for on in (w > 0, np.ones(len(w)))]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([(n * w) @ p, *outer]).tolist()], pa.list_(pa.float64()))],
                                             names=["sums"])
    return run


def _summed(df: DataFrame, size: int) -> np.ndarray:
    row = df.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).first()
    return np.array([x or 0.0 for x in row])


def _moment_sums(features: DataFrame, d: int, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sums = _summed(features.select("n_tokens", "posterior").mapInArrow(tidy(_moments(d, steps)), "sums array<double>"), d + 2 * d * d)
    return sums[:d], sums[d:d + d * d].reshape(d, d), sums[d + d * d:].reshape(d, d)


def fit_rates(features: DataFrame, targets: np.ndarray, rounds: int = MIX_ROUNDS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Step vectors of the projected gradient; features: n_tokens, posterior.

    A document weighs as its tokens and a domain as its second moment over the
    documents that are above rate 0 (a step that does not lessen the residual is
    taken back for one over all documents, which always descends).  Targets that
    cannot be met end at the least squares in that scale.  A domain whose
    target is NaN is free: nothing is asked of it.
    """
    d, asked = len(targets), np.flatnonzero(~np.isnan(targets))
    scale = max(1.0, float(np.nansum(targets)))
    steps: list[np.ndarray] = []
    totals, active, full = _moment_sums(features, d, steps)
    residual, bold = (totals - targets)[asked], True
    for _ in range(rounds):
        if not len(asked) or np.abs(residual).max() <= tolerance * scale:
            break
        step = np.zeros(d)
        step[asked] = np.linalg.pinv((active if bold else full)[np.ix_(asked, asked)], rcond=1e-9, hermitian=True) @ residual
        totals, new_active, _ = _moment_sums(features, d, [*steps, step])
        left = (totals - targets)[asked]
        if bold and np.linalg.norm(left) >= 0.9 * np.linalg.norm(residual):
            bold = False
            continue
        steps.append(step)
        stalled = not bold and np.linalg.norm(left) > 0.999 * np.linalg.norm(residual)
        residual, active, bold = left, new_active, True
        if stalled:                                          # nonnegative rates come no closer
            break
    return steps


def fit_bounded(features: DataFrame, goal: np.ndarray, least: dict[int, float | None], most: dict[int, float | None],
                total: float | None = None) -> list[np.ndarray]:
    """Step vectors as ``fit_rates`` finds them, for domains of which some have a bound instead of a target.

    ``goal``: targets, NaN where a domain has none.  ``least``, ``most``: the
    domains' bounds as shares of ``total`` tokens (default: of the mixture that
    comes out), None for their present tokens; a least share is never below
    those.  A bound that the rates break becomes a target of the next fit, until
    no domain is beyond its bound: what one domain brings of another, or takes
    from it, is made up for.  A fit to the same targets that comes no nearer (there
    is no text that could meet them) ends the search, and the nearest one counts.
    """
    now = present = _moment_sums(features, len(goal), [])[0]
    best: list[np.ndarray] = []
    steps, held, nearest = best, {}, np.inf
    for _ in range(BOUND_ROUNDS):
        size = float(now.sum()) if total is None else total
        least_of = {i: present[i] if x is None else max(x * size, present[i]) for i, x in least.items()}
        most_of = {i: present[i] if x is None else x * size for i, x in most.items()}
        gaps = {i: abs(now[i] - x) for i, x in enumerate(goal) if not np.isnan(x)}
        gaps |= {i: x - now[i] for i, x in least_of.items()} | {i: now[i] - x for i, x in most_of.items()}
        slack = BOUND_TOLERANCE * max(1.0, size)
        worst = max(gaps.values(), default=0.0) / max(1.0, size)
        broken = {i for i, gap in gaps.items() if gap > slack and (i in least or i in most)}
        far = worst > 0.9 * nearest and broken <= held.keys()
        if worst < nearest - BOUND_TOLERANCE:
            best, nearest = steps, worst
        if worst <= BOUND_TOLERANCE or far:
            break
        for i in broken | held.keys():
            held[i] = most[i] if i in most else least[i] if least_of[i] > present[i] else None
        if total is None:                                    # the size at which the held domains have their shares
            shares = sum(x for x in held.values() if x is not None)
            others = sum(present[i] if i in held else now[i] for i in range(len(goal)) if held.get(i) is None)
            size = others / (1 - shares) if shares < 1 else size
        asked = goal.copy()
        for i, x in held.items():
            asked[i] = present[i] if x is None else x * size
        steps = fit_rates(features, asked)
        now = _moment_sums(features, len(goal), steps)[0]
    return best


def _apply(d: int, steps):
    def run(batches):
        for rb in batches:
            p = _matrix(rb.column(rb.schema.get_field_index("posterior")), d)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(rates_of(p, steps))], names=[*rb.schema.names, "rate"])
    return run


def _numbered(spark: SparkSession, rows: DataFrame, key: str, number: str, text: str, doc_id: str, seed: int) -> DataFrame:
    """``rows`` with ``key`` (hash of id and text) and ``number`` among the rows of that key; only repeated keys are sorted."""
    plain = [f"`{f.name}`" for f in rows.schema if "map<" not in f.dataType.simpleString()]
    rows = rows.withColumn(key, F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").isNull(), f"`{doc_id}`", f"`{text}`"))
    often = write_table(spark, rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias(key)), "mix-often")
    if often.isEmpty():
        return rows.withColumn(number, F.lit(1))
    order = Window.partitionBy(key).orderBy(F.xxhash64(*plain))
    again = rows.join(often, key, "left_semi").withColumn(number, F.row_number().over(order))
    return rows.join(often, key, "left_anti").withColumn(number, F.lit(1)).unionByName(again)


def mix_to_targets(spark: SparkSession, docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float | None], *,
                   text: str = "text", doc_id: str = "doc_id", total: float | None = None,
                   leave_out: dict[str, float] | None = None, at_least: Sequence[str] = (), seed: int = COPY_SEED) -> DataFrame:
    """``docs`` with n_tokens, posterior (per domain in the targets' order), rate and copies.

    ``targets``: each domain's share of ``total`` tokens (default: all tokens of
    ``docs``); None keeps a domain's present expected tokens.  ``copies`` is
    the whole part of the rate, and one more where a hash of (``seed``, doc_id,
    text, number among equal rows) is below the fraction: token totals of the
    copies hold in expectation (0: the document is left out).  A null or
    wordless text has no tokens; its posterior is the prior and its rate follows.
    Repeated rows each take part; a document labelled several times counts with
    its first domain.  Columns with the new names are replaced.

    ``leave_out``: domains that should go, with the posterior above which a
    document has rate 0, however many such documents there are.  They take no
    part in the present tokens of any domain, and the target of such a domain is
    never above what the others have of it.  If no label is usable, no document
    is known to belong to such a domain, and it keeps its present tokens.

    ``at_least``: domains whose share is the least they should have, and none
    has fewer than its present tokens; the share of a domain of ``leave_out`` is
    then the most it may have.  Without ``total`` these shares are of the tokens
    of the mixture that comes out (``fit_bounded``).
    """
    new = ("n_tokens", "posterior", "rate", "copies")
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in new])
    names = list(targets)
    d = len(names)
    weights = fit_domains(spark, docs, labels, domain, names, text=text, doc_id=doc_id)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scored = docs.mapInArrow(tidy(_posteriors(spark.sparkContext.broadcast(weights), text)), f"{fields}, n_tokens long, posterior array<double>")
    scored = write_table(spark, scored, "mix-scored")
    limits = leave_out if leave_out and weights.any() else {}
    gone = F.lit(False)
    for x, limit in limits.items():
        gone = gone | (F.get("posterior", F.lit(names.index(x))) > limit)
    rest = scored.where(~gone) if limits else scored
    present = _moment_sums(rest, d, [])[0]
    tokens = float(scored.agg(F.sum("n_tokens")).first()[0] or 0) if total is None else float(total)
    goal = np.array([present[i] if targets[x] is None else targets[x] * tokens for i, x in enumerate(names)])
    for x in leave_out or {}:
        i = names.index(x)
        goal[i] = min(goal[i], present[i]) if limits else present[i]
    if at_least:
        least, most = ({names.index(x): targets[x] for x in some} for some in (at_least, limits))
        goal[[*least, *most]] = np.nan
        steps = fit_bounded(rest, goal, least, most, total)
    else:
        steps = fit_rates(rest, goal)
    out = scored.mapInArrow(tidy(_apply(d, steps)), f"{fields}, n_tokens long, posterior array<double>, rate double")
    out = out.withColumn("rate", F.when(gone, 0.0).otherwise(F.col("rate"))) if limits else out
    key, number = unused(out, "__key", "__number")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, number), 11).cast("double") / float(1 << 53)
    return (_numbered(spark, out, key, number, text, doc_id, seed)
            .withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))
            .drop(key, number))


def label_domain() -> Column:
    """Domain of a row of ``labels``: toxic, else good or poor by quality; null where that is unknown."""
    return (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"))
