"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary
(plus all single bytes), fitted by expectation-maximisation on a bounded sample
of labelled texts.  A word's probability is the sum over all its segmentations
into pieces, by the forward algorithm; words with equal byte lengths run
through it together, for all languages at once.  A text's score is the product
over its words, and the prediction is the language of greatest posterior.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import tidy, tidy_group

#: labelled texts used per language (expected number of a hashed sample)
TRAIN_TEXTS = 400
EM_ROUNDS = 3
#: longer words are scored in parts of so many bytes
WORD_BYTES = 48
#: longest piece considered, in bytes
PIECE_BYTES = 12
#: added to every piece's expected count
SMOOTH = 0.02
#: probabilities are scaled by 2 to this power per byte while a word's segmentations are summed
SCALE_BITS = 10
#: words that a worker remembers
MEMO = 200_000
_MARK = "▁".encode()
_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def load_pieces(model_file: str) -> dict[bytes, int]:
    """Piece bytes -> number, from a SentencePiece model; every single byte is a piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces: dict[bytes, int] = {bytes([b]): b for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        raw = sp.id_to_piece(i).encode()
        if len(raw) <= PIECE_BYTES:
            pieces.setdefault(raw, len(pieces))
    return pieces


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def _text_words(text: str, piece: int = 1 << 20):
    """``words_of`` in bounded parts of a long text, cut where no letter stands."""
    if len(text) <= piece:
        yield words_of(text)
        return
    at = 0
    while at < len(text):
        stop = min(at + piece, len(text))
        while stop < len(text) and text[stop].isalnum():
            stop += 1
        yield words_of(text[at:stop])
        at = stop


def _parts(word: str) -> list[bytes]:
    raw = _MARK + word.encode("utf-8", "surrogatepass")
    return [raw[i:i + WORD_BYTES] for i in range(0, len(raw), WORD_BYTES)]


class PieceTable:
    """Finds vocabulary pieces in byte strings: per length, sorted 64-bit hashes behind a small bitmap."""

    def __init__(self, pieces: dict[bytes, int]):
        self.by_len: dict[int, tuple] = {}
        for m in sorted({len(p) for p in pieces}):
            own = [(p, i) for p, i in pieces.items() if len(p) == m]
            flat = np.frombuffer(b"".join(p for p, _ in own), np.uint8).reshape(-1, m)
            h = np.zeros(len(own), np.uint64)
            for c in range(m):
                h = self._step(h, flat[:, c])
            order = np.argsort(h)
            seen = np.zeros(1 << 18, bool)
            seen[(h >> np.uint64(46)).astype(np.int64)] = True
            self.by_len[m] = (h[order], np.array([i for _, i in own], np.int32)[order], seen)
        self.longest = max(self.by_len)

    @staticmethod
    def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    def match(self, flat: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
        """For m = 0, 1, ...: the piece of m bytes at each position (-1: none); room: bytes left to the part's end."""
        n = len(flat)
        out, h = [np.zeros(0, np.int32)], np.zeros(n, np.uint64)
        for m in range(1, self.longest + 1):
            if n - m + 1 <= 0 or not (room >= m).any():
                break
            h = self._step(h[:n - m + 1], flat[m - 1:])
            ids = np.full(n, -1, np.int32)
            if m in self.by_len:
                hashes, numbers, seen = self.by_len[m]
                may = np.flatnonzero(seen[(h >> np.uint64(46)).astype(np.int64)] & (room[:n - m + 1] >= m))
                at = np.searchsorted(hashes, h[may])
                at[at == len(hashes)] = 0
                hit = hashes[at] == h[may]
                ids[may[hit]] = numbers[at[hit]]
            out.append(ids)
        return out


class _Lattice:
    """Parts of words, longest first, with the pieces that stand at each of their positions."""

    def __init__(self, parts: list[bytes], who: np.ndarray, table: PieceTable):
        self.who = who
        self.lens = np.array([len(parts[i]) for i in who], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        flat = np.frombuffer(b"".join([parts[i] for i in who]), np.uint8)
        room = np.repeat(self.starts + self.lens, self.lens) - np.arange(len(flat))
        self.ids = table.match(flat, room)
        #: how many parts have at least so many bytes
        self.having = np.searchsorted(-self.lens, -np.arange(int(self.lens[0]) + 2), "right")

    def edges(self, backwards: bool = False):
        """(start, length, part numbers, pieces) of all places of equal start and length, in order of start."""
        n = int(self.lens[0])
        for s in (range(n - 1, -1, -1) if backwards else range(n)):
            for m in range(1, min(len(self.ids) - 1, n - s) + 1):
                k = self.ids[m][self.starts[:self.having[s + m]] + s]
                has = np.flatnonzero(k >= 0)
                if len(has):
                    yield s, m, has, k[has]

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """alpha [part, position, language]: summed probability of all segmentations up to the position."""
        alpha = np.zeros((len(self.lens), int(self.lens[0]) + 1, probs.shape[1]))
        alpha[:, 0] = 1
        for s, m, has, k in self.edges():
            alpha[has, s + m] += alpha[has, s] * probs[k]
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(self.lens)), self.lens]

    def backward(self, probs: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.lens), int(self.lens[0]) + 1, probs.shape[1]))
        beta[np.arange(len(self.lens)), self.lens] = 1
        for s, m, has, k in self.edges(backwards=True):
            beta[has, s] += beta[has, s + m] * probs[k]
        return beta


def _lattices(parts: list[bytes], table: PieceTable):
    order = np.argsort([-len(p) for p in parts], kind="stable")
    for a in range(0, len(order), 8192):
        yield _Lattice(parts, order[a:a + 8192], table)


def fit_pieces(counts: dict[str, int], pieces: dict[bytes, int], rounds: int = EM_ROUNDS) -> np.ndarray:
    """Piece probabilities that (locally) maximise the segmentation-marginal likelihood of the words."""
    weight: Counter = Counter()
    for w, c in counts.items():
        for p in _parts(w):
            weight[p] += c
    parts = list(weight)
    mass = np.array([weight[p] for p in parts], float)
    size = len(pieces)
    lattices = list(_lattices(parts, PieceTable(pieces)))
    probs = np.full((size, 1), 1.0 / size)
    for _ in range(rounds):
        expected = np.zeros(size)
        for lat in lattices:
            alpha, beta = lat.forward(probs), lat.backward(probs)[:, :, 0]
            share = mass[lat.who] / lat.total(alpha)[:, 0]
            for s, m, has, k in lat.edges():
                expected += np.bincount(k, alpha[has, s, 0] * probs[k, 0] * beta[has, s + m] * share[has], minlength=size)
        probs = ((expected + SMOOTH) / (expected + SMOOTH).sum())[:, None]
    return probs[:, 0]


class Model:
    """Languages, pieces and their probabilities [piece, language]."""

    def __init__(self, langs: list[str], pieces: dict[bytes, int], probs: np.ndarray):
        if len(langs) > 1:                           # what no language has seen tells none from another
            least = probs.min(axis=0)
            probs = np.where((probs <= least * (1 + 1e-9)).all(axis=1)[:, None], np.exp(np.log(least).mean()), probs)
        self.langs, self.table, self.probs = langs, PieceTable(pieces), probs
        size = np.zeros(len(pieces))
        size[list(pieces.values())] = [len(p) for p in pieces]
        #: as many factors as a segmentation has bytes, whatever its pieces: no sum underflows
        self.scaled = probs * (2.0 ** (SCALE_BITS * size))[:, None]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language; nan for words without a letter."""
        parts, owner = [], []
        for i, w in enumerate(words):
            for p in _parts(w):
                parts.append(p)
                owner.append(i)
        out = np.zeros((len(words), len(self.langs)))
        owner = np.array(owner, np.int64)
        for lat in _lattices(parts, self.table):
            log = np.log(lat.total(lat.forward(self.scaled))) - (SCALE_BITS * np.log(2.0) * lat.lens)[:, None]
            np.add.at(out, owner[lat.who], log)
        for i, w in enumerate(words):
            if not w.isalpha() and not any(c.isalpha() for c in w):
                out[i] = np.nan
        return out


class Scorer:
    """Scores texts; scores of words seen before are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.table = np.zeros((1024, len(model.langs)))

    def _learn(self, words: list[str]) -> None:
        new = [w for w in set(words) if w not in self.at]
        if not new:
            return
        if len(self.at) + len(new) > MEMO:
            self.at.clear()
            new = list(set(words))
        n = len(self.at)
        if n + len(new) > len(self.table):
            table = np.zeros((2 * (n + len(new)), self.table.shape[1]))
            table[:n] = self.table[:n]
            self.table = table
        self.table[n:n + len(new)] = self.model.word_scores(new)
        self.at.update(zip(new, range(n, n + len(new))))

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total = np.zeros((len(texts), len(self.model.langs)))
        letters = np.zeros(len(texts), bool)
        held: list[str] = []
        owner: list[tuple[int, int]] = []

        def flush():
            if held:
                self._learn(held)
                s = self.table[np.fromiter(map(self.at.__getitem__, held), np.int64, len(held))]
                d = np.repeat([o for o, _ in owner], [c for _, c in owner])
                real = ~np.isnan(s[:, 0]) if s.shape[1] else np.ones(len(s), bool)
                letters[d[real]] = True
                for lang in range(s.shape[1]):
                    total[:, lang] += np.bincount(d[real], s[real, lang], minlength=len(texts))
                held.clear()
                owner.clear()

        for i, t in enumerate(texts):
            if t is None:
                continue
            for words in _text_words(t):
                held += words
                owner.append((i, len(words)))
                if len(held) > 100_000:
                    flush()
        flush()
        if not self.model.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        best = total.argmax(axis=1)
        post = np.exp(total - total.max(axis=1, keepdims=True))
        score = post[np.arange(len(texts)), best] / post.sum(axis=1)
        return ([self.model.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters)],
                [float(x) if ok else 0.0 for x, ok in zip(score, letters)])


def held_out(doc_id: Column | str) -> Column:
    """Documents kept out of learning: crc32 of the id as text is 2 mod 4 (a null id is not held out)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(batches):
    """(lang, text) -> one row of word counts per language and batch."""
    for rb in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(rb.column(0).to_pylist(), rb.column(1)):
            c = counts.setdefault(lang, Counter())
            for words in _text_words(text.as_py()):
                c.update(words)
        langs = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array([list(counts[x]) for x in langs], pa.list_(pa.string())),
             pa.array([list(counts[x].values()) for x in langs], pa.list_(pa.int64()))], names=["lang", "words", "counts"])


def _fit(pieces):
    def run(t: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for words, counts in zip(t["words"].to_pylist(), t["counts"].to_pylist()):
            for w, c in zip(words, counts):
                total[w] += c
        total = Counter({w: c for w, c in total.items() if any(map(str.isalpha, w))})
        probs = fit_pieces(total, pieces.value)
        return pa.table({"lang": t["lang"].slice(0, 1), "probs": pa.array([probs.astype("<f8").tobytes()], pa.binary())})
    return run


def fit_language_model(spark: SparkSession, docs: DataFrame, piece_model: str, *, text: str = "text", lang: str = "lang",
                       doc_id: str = "doc_id", train_texts: int = TRAIN_TEXTS, learn: Column | None = None) -> Model:
    """Fit piece probabilities per language on a hashed sample of about ``train_texts`` labelled texts each.

    Only rows with a non-null language and text that ``learn`` selects (by
    default those not held out) are counted and used.  The model on the driver
    is vocabulary x languages, whatever the corpus.
    """
    pieces = load_pieces(piece_model)
    learn = ~held_out(doc_id) if learn is None else learn
    rows = (docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, F.lit("train")).alias("h")))
    share = rows.groupBy("lang").agg((F.lit(float(train_texts)) / F.count("*")).alias("share"))
    u = (F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53))
    sample = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text")
    shared = spark.sparkContext.broadcast(pieces)
    fitted = (sample.mapInArrow(tidy(_count_words), "lang string, words array<string>, counts array<long>")
              .groupBy("lang").applyInArrow(tidy_group(_fit(shared)), "lang string, probs binary").collect())
    fitted = sorted((r["lang"], np.frombuffer(r["probs"], "<f8")) for r in fitted) if fitted else []
    probs = np.stack([p for _, p in fitted], axis=1) if fitted else np.zeros((len(pieces), 0))
    return Model([x for x, _ in fitted], pieces, probs)


def _predict(model, text_col: str):
    def run(batches):
        scorer = Scorer(model.value)
        for rb in batches:
            texts = rb.column(rb.schema.get_field_index(text_col))
            langs, scores = [], []
            for a in range(0, rb.num_rows, 256):
                x, y = scorer.texts(texts.slice(a, 256).to_pylist())
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*rb.schema.names, "lang_pred", "score"])
    return run


def predict_language(spark: SparkSession, docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (its posterior), from the text alone.

    ``und`` and 0 for a null text or one without a letter, and for all rows if
    no language was learned.  Equal posteriors go to the language first in
    order.  Columns named lang_pred or score are replaced.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(_predict(spark.sparkContext.broadcast(model), text)), f"{fields}, lang_pred string, score double")
