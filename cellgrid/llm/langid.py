"""Language identification by interpolated Kneser-Ney character models.

One model per language is learned from labelled texts: counts of character
``ORDER``-grams and of the shorter grams they continue, with one absolute
discount per order.  A text's language is the one with the lowest cross-entropy
per character; calibrated thresholds reject texts that no model explains.

* All labelled texts are used for fitting, both for the counts and for the
  thresholds; whole texts are counted and scored, in Spark.  A caller may ask for
  about ``rows_per_lang`` texts per language instead, chosen by a hash of the id.
* The models are sorted arrays of 64-bit gram hashes.  A gram seen in any
  language has one row of log probabilities, one per language; a gram never seen
  adds the backoff weights of its context and falls to the next order.  A table
  over the leading hash bits points into the sorted array.
* The arrays hold every different gram of the texts used for fitting, whose number
  grows much slower than the texts; they are sent to the executors once as a
  broadcast variable.

Nulls: null labels are not learned; a null text and a text without letters are
``und`` with score 0.  Labels of texts that are not training rows are never
read.  Ties go to the first language in order of name.  Repeated rows get equal
results; without training rows everything is ``und``.  An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import fresh, map_texts, names, prepare, quoted

ORDER = 4
# A gram has one probability per language; more labels than this are an error.
MAX_LANGS = 500
# Characters scored at a time.
CHUNK = 1 << 19
UNKNOWN = "und"

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 65,536: its lower-case letter or a blank, and whether it is a letter."""
    lower = np.full(65536, 32, np.uint16)
    known = np.zeros(65536, bool)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
            known[c] = True
    return lower, known


_TABLES: list = []


def normalised(text: str | None) -> np.ndarray:
    """Lower-case letters with single blanks between words, as code points; empty without any letter."""
    if not _TABLES:
        _TABLES.extend(_letters())
    lower, known = _TABLES
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes > 65535
    low = np.where(high, 0, codes)
    letter = known[low]
    out = lower[low].astype(np.uint32)
    if high.any():
        astral = np.array([chr(c).isalpha() if c < 0x110000 else False for c in codes[high].tolist()], bool)
        # folded into the private use area, so that a code takes 16 bits
        out[high] = np.where(astral, 0xE000 + codes[high] % 6400, 32)
        letter[high] = astral
    if not letter.any():
        return np.zeros(0, np.uint32)
    out[~letter] = 32
    blank = out == 32
    again = np.zeros(len(out), bool)
    again[1:] = blank[1:] & blank[:-1]
    return out[~again]


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` code points up to each place from ``order - 1`` on."""
    x = codes.astype(np.uint64) + np.uint64(1)
    n = len(x) - order + 1
    h = np.full(max(n, 0), np.uint64(order), np.uint64)
    for i in range(order):
        h = (h ^ x[i : i + n]) * _M
        h ^= h >> np.uint64(31)
    return h * _N


def _padded(codes: np.ndarray) -> np.ndarray:
    """Blanks in front, so that the first letters have full contexts, and one behind."""
    return np.concatenate((np.full(ORDER - 1, 32, np.uint32), codes, [np.uint32(32)]))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, gram bigint, n)``: counts of the full-order grams of ``labelled(lang, text)``, 16 bits per letter."""

    def run(part):
        langs, grams, ns = [], [], []
        for lang in sorted(set(part["lang"])):
            packed = []
            for text, own in zip(part["text"], part["lang"]):
                codes = normalised(text) if own == lang else ()
                if len(codes):
                    codes = _padded(codes).astype(np.uint64)
                    n = len(codes) - ORDER + 1
                    gram = codes[:n].copy()
                    for i in range(1, ORDER):
                        gram = gram << np.uint64(16) | codes[i : i + n]
                    packed.append(gram)
            if packed:
                unique, counts = np.unique(np.concatenate(packed), return_counts=True)
                langs += [lang] * len(unique)
                grams += unique.view(np.int64).tolist()
                ns += counts.tolist()
        yield {"lang": langs, "gram": grams, "n": ns}

    counted = map_texts(labelled, run, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def unpacked(grams: np.ndarray) -> np.ndarray:
    """Rows of code points of packed grams."""
    places = np.arange(16 * (ORDER - 1), -1, -16).astype(np.uint64)
    return (grams.view(np.uint64)[:, None] >> places & np.uint64(0xFFFF)).astype(np.int64)


class SortedHashes:
    """Rows of values by hash: a sorted array and a directory over the leading bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.shift = np.uint64(64 - max(8, int(len(hashes)).bit_length() + 1))
        bounds = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.float64) * float(1 << int(self.shift))
        heads = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange(len(bounds))).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(hashes) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.hashes):
            return out
        head = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        open_ = np.arange(len(wanted))
        last = len(self.hashes) - 1
        for step in range(self.longest):
            here = at[open_] + step
            inside = here < end[open_]
            open_, here = open_[inside], here[inside]
            same = self.hashes[np.minimum(here, last)] == wanted[open_]
            out[open_[same]] = here[same]
            open_ = open_[~same]
            if not len(open_):
                break
        return out


class KneserNey:
    """Interpolated models of all languages over shared sorted hash arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``counts``: for each language its distinct full-order grams (rows of code points) and their counts."""
        self.langs = sorted(counts)
        width = len(self.langs)
        alphabet = len({c for grams, _ in counts.values() for c in np.unique(grams).tolist()}) + 1
        # grams and counts by order: full counts at the top, numbers of distinct predecessors below
        levels: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [dict() for _ in range(ORDER + 1)]
        for k, lang in enumerate(self.langs):
            grams, n = counts[lang]
            levels[ORDER][k] = (grams, n.astype(np.float64))
            for order in range(ORDER - 1, 0, -1):
                grams, n = np.unique(grams[:, 1:], axis=0, return_counts=True)
                levels[order][k] = (grams, n.astype(np.float64))
        floor = np.full(width, np.log(1 / alphabet))
        self.floor = floor
        self.tables: list[SortedHashes] = []
        self.backoff: list[SortedHashes] = []
        lower = None
        for order in range(1, ORDER + 1):
            hashed = {k: self._hash(g, order) for k, (g, _) in levels[order].items()}
            union, place = np.unique(np.concatenate(list(hashed.values())), return_index=True)
            grams = np.concatenate([g for g, _ in levels[order].values()])[place]
            contexts = self._hash(grams[:, :-1], order - 1)
            ctx_union, ctx_of = np.unique(contexts, return_inverse=True)
            # probabilities of the shorter gram under each language
            below = np.tile(floor, (len(union), 1)) if lower is None else lower.log_probabilities(grams[:, 1:])
            logp = np.zeros((len(union), width))
            weight = np.zeros((len(ctx_union), width))
            for k, (g, n) in levels[order].items():
                rows = np.searchsorted(union, hashed[k])
                c = np.zeros(len(union))
                c[rows] = n
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(ctx_of, c, len(ctx_union))
                kinds = np.bincount(ctx_of, c > 0, len(ctx_union))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gamma = np.where(total > 0, discount * kinds / total, 1.0)
                    own = np.where(total[ctx_of] > 0, np.maximum(c - discount, 0) / total[ctx_of], 0.0)
                logp[:, k] = np.log(own + gamma[ctx_of] * np.exp(below[:, k]))
                weight[:, k] = np.log(gamma)
            self.tables.append(SortedHashes(union, logp.astype(np.float32)))
            self.backoff.append(SortedHashes(ctx_union, weight.astype(np.float32)))
            lower = self

    @staticmethod
    def _hash(grams: np.ndarray, order: int) -> np.ndarray:
        h = np.full(len(grams), np.uint64(order), np.uint64)
        for i in range(order):
            h = (h ^ (grams[:, i].astype(np.uint64) + np.uint64(1))) * _M
            h ^= h >> np.uint64(31)
        return h * _N

    def _score(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log probabilities; ``hashes`` and ``contexts`` from order 1 up to the highest known."""
        out = np.zeros((len(hashes[0]), len(self.langs)), np.float32)
        rest = np.arange(len(hashes[0]))
        for order in range(len(hashes), 0, -1):
            row = self.tables[order - 1].find(hashes[order - 1][rest])
            hit = row >= 0
            out[rest[hit]] += self.tables[order - 1].values[row[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            row = self.backoff[order - 1].find(contexts[order - 1][rest])
            hit = row >= 0
            out[rest[hit]] += self.backoff[order - 1].values[row[hit]]
        out[rest] += self.floor.astype(np.float32)
        return out

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        top = grams.shape[1]
        hashes = [self._hash(grams[:, top - k :], k) for k in range(1, top + 1)]
        contexts = [self._hash(grams[:, top - k : top - 1], k - 1) for k in range(1, top + 1)]
        return self._score(hashes, contexts).astype(np.float64)

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy in nats per character of each normalised, not empty text under each language."""
        sums = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) + 1 for t in texts])
        group, held = [], 0
        for i, text in enumerate(texts):
            group.append(i)
            held += len(text)
            if held >= CHUNK or i == len(texts) - 1:
                self._add([texts[j] for j in group], group, sums)
                group, held = [], 0
        return -sums / sizes[:, None]

    def _add(self, texts: list[np.ndarray], rows: list[int], sums: np.ndarray) -> None:
        joined = np.concatenate([_padded(t) for t in texts])
        owner = np.repeat(rows, [len(t) + ORDER for t in texts])
        last = len(joined)
        inner = np.ones(last, bool)
        at = 0
        for t in texts:
            inner[at : at + ORDER - 1] = False
            at += len(t) + ORDER
        # pieces overlap by a context, so a long text needs no more memory than a short one
        for start in range(0, last, CHUNK):
            lo, hi = max(0, start - ORDER + 1), min(last, start + CHUNK)
            piece = joined[lo:hi]
            ends = np.flatnonzero(inner[start:hi]) + (start - lo)
            hashes, contexts = [], []
            for k in range(1, ORDER + 1):
                hashes.append(gram_hashes(piece, k)[ends - k + 1])
                contexts.append(gram_hashes(piece, k - 1)[ends - k + 1] if k > 1 else np.full(len(ends), self._hash(np.zeros((1, 0)), 0)[0]))
            scores = self._score(hashes, contexts)
            who = owner[lo:hi][ends]
            for k in range(scores.shape[1]):
                sums[:, k] += np.bincount(who, scores[:, k], len(sums))


class Identifier:
    """Models with the score and the rejection thresholds of their training texts."""

    def __init__(self, model: KneserNey | None, limits: dict[str, float] | None = None):
        self.model, self.limits = model, limits or {}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[bool]]:
        """Language, score from 0 to 1, cross-entropy and rejection of each text."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        entropy: list[float | None] = [None] * len(texts)
        rejected = [True] * len(texts)
        codes = [normalised(t) for t in texts] if self.model else []
        rows = [i for i, c in enumerate(codes) if len(c)]
        if rows:
            h = self.model.entropies([codes[i] for i in rows])
            best = h.argmin(axis=1)
            # the share of the best language when a letter's odds are spread over at most 20 letters
            lengths = np.array([min(len(codes[i]), 20) for i in rows])
            share = 1 / np.exp(-(h - h.min(axis=1, keepdims=True)) * lengths[:, None]).sum(axis=1)
            for i, k, s, e in zip(rows, best.tolist(), share.tolist(), h.min(axis=1).tolist()):
                langs[i] = self.model.langs[k]
                scores[i], entropy[i] = s, e
                rejected[i] = e > self.limits.get(langs[i], np.inf)
        return langs, scores, entropy, rejected


def training_rows(docs: DataFrame, rows_per_lang: int | None, id_col: str, text: str, lang: str) -> DataFrame:
    """``(lang, text)`` of all labelled rows, or of about ``rows_per_lang`` of each language, by a hash of the id."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} different labels")
    if rows_per_lang is None or not sizes:
        return labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], float(rows_per_lang) / r["n"])))
    drawn: Column = F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).bitwiseAND(F.lit((1 << 30) - 1))
    return labelled.where(drawn / F.lit(float(1 << 30)) < share[F.col(lang)]).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )


def fit(
    docs: DataFrame,
    rows_per_lang: int | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = 0.999,
    slack: float = 1.25,
) -> Identifier:
    """Models of the labelled ``docs``, and a rejection threshold per language.

    The threshold is ``slack`` times the ``quantile`` of the cross-entropy of
    the language's training texts.
    """
    rows = training_rows(docs, rows_per_lang, id_col, text, lang)
    prepare(docs.sparkSession)
    table = gram_counts(rows).toArrow()
    if not table.num_rows:
        return Identifier(None)
    langs = np.array(table.column("lang").to_pylist(), object)
    grams = unpacked(np.ascontiguousarray(table.column("gram").to_numpy()))
    n = table.column("n").to_numpy()
    model = KneserNey({g: (grams[langs == g], n[langs == g]) for g in sorted(set(langs.tolist()))})
    plain = docs.sparkSession.sparkContext.broadcast(Identifier(model))

    def run(part):
        _, _, entropy, _ = plain.value.predict(part["text"])
        yield {"lang": part["lang"], "entropy": entropy}

    seen = map_texts(rows, run, "lang string, entropy double").where("entropy IS NOT NULL")
    bounds = seen.groupBy("lang").agg(F.percentile_approx("entropy", quantile, 10000).alias("q")).collect()
    return Identifier(model, {r["lang"]: slack * r["q"] for r in bounds})


def identify(docs: DataFrame, identifier: Identifier, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and as the last column the struct ``language(lang, score, entropy, rejected)``.

    Its name is longer if a carried column has that name.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(identifier)
    inner = docs.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names(carry))), F.col(text).alias("text"))
    schema = ", ".join(
        [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
        + ["language struct<lang:string,score:double,entropy:double,rejected:boolean>"]
    )

    def run(part):
        found = zip(*sent.value.predict(part["text"]))
        out = [dict(zip(("lang", "score", "entropy", "rejected"), f)) for f in found]
        yield {k: v for k, v in part.items() if k != "text"} | {"language": out}

    got = map_texts(inner, run, schema)
    name = fresh(docs.select(*quoted(carry)), "language")
    return got.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), F.col("language").alias(name))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept away from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that a model explains, with their columns."""
    identifier = fit(docs, id_col=id_col, text=text, lang=lang)
    found = identify(docs, identifier, docs.columns, text)
    return found.where(~F.col(found.columns[-1])["rejected"]).select(*quoted(docs.columns))
