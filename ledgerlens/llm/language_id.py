"""Language identification by interpolated Kneser-Ney character models, one per language.

Training counts every character 4-gram of every training text (lower-cased letters, other runs as one blank): counts
are summed inside a task, then by Spark. Orders below 4 use continuation counts, and every order is interpolated with
the one below by absolute discounting, down to a uniform distribution over the alphabet.

The models are looked up through sorted hash arrays: the keys of an order are 64-bit hashes in ascending order, an
index over their leading bits gives the start of the few keys to compare, and the values are the interpolated
log-probabilities of all languages. A text is scored whole; its cross-entropy is divided by its length, and the
lowest wins. The distances between a text's cross-entropy and its language's mean, in deviations that shrink with
the length, are calibrated on all training texts that were not counted (one in HELD_BACK by a hash of the id): a text beyond
MARGIN times a high quantile (QUANTILE) of its language's distances there is rejected.

Nothing is pruned: a model holds all 4-grams of its language, and lower orders are derived from all of them. The models
lie in the memory of the driver and of every worker, so these grow with the distinct 4-grams times the languages.

Edge cases: a null text and a text without a letter are `und`, rejected, score 0; texts without a language do not
train; without any training text every text is `und`; repeated rows are predicted each; a null id is never
trained on; columns other than text, id and language are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

ORDER = 4
HELD_BACK = 16
MARGIN = 1.5
QUANTILE = 0.999
#: Deviations that are never a reason to reject, before the margin.
USUAL = 4.0
DISCOUNT = 0.75
#: Characters over which the score compares languages.
EVIDENCE = 32
BLANK = 0x20


def letter_table() -> np.ndarray:
    """Symbol of every code point: letters stand for themselves (beyond 16 bits for one symbol), the rest is blank."""
    kept = C.worker_store()
    if "letters" not in kept:
        codes = np.full(sys.maxunicode + 1, BLANK, dtype=np.uint16)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                codes[c] = min(c, 0xFFFF)
        kept["letters"] = codes
    return kept["letters"]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(a blank and then the symbols of all texts, offsets of the texts behind that blank).

    A text is its letters, with one blank for every run of other characters and one at its end; a text without
    a letter is empty.
    """
    joined = "".join((t or "").replace("\x00", " ") + "\x00" for t in texts).lower()
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = letter_table()[raw]
    letter = codes != BLANK
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    before = np.r_[0, np.cumsum(keep)]
    offsets = before[np.r_[0, np.flatnonzero(raw == 0) + 1]]
    return np.concatenate([[BLANK], codes[keep]]).astype(np.uint64), offsets


def packed(syms: np.ndarray, order: int) -> np.ndarray:
    """The last `order` symbols at every position, 16 bits each, from position order - 1 on."""
    n = max(0, len(syms) - order + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(order):
        out = (out << np.uint64(16)) | syms[j : j + n]
    return out


def _padded(syms: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(ORDER - 2, BLANK, np.uint64), syms])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition, summed; memory follows the distinct 4-grams."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    pending: dict[str, list] = {}

    def settle(lang: str) -> None:
        keys, inverse_counts = [], []
        if lang in sums:
            keys.append(sums[lang][0])
            inverse_counts.append(sums[lang][1])
        if pending.get(lang):
            new, n = np.unique(np.concatenate(pending.pop(lang)), return_counts=True)
            keys.append(new)
            inverse_counts.append(n)
        if not keys:
            return
        flat, n = np.concatenate(keys), np.concatenate(inverse_counts)
        order = np.argsort(flat, kind="stable")
        flat, n = flat[order], n[order]
        at = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, int)
        sums[lang] = flat[at], np.add.reduceat(n, at) if len(flat) else n

    size: dict[str, int] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        texts = batch.column(0)
        for lang in sorted(set(langs)):
            rows = np.flatnonzero(langs == lang)
            for part in np.array_split(rows, max(1, len(rows) // 128)):
                syms, _ = symbols(texts.take(pa.array(part)).to_pylist())
                grams = packed(_padded(syms), ORDER)
                pending.setdefault(lang, []).append(grams)
                size[lang] = size.get(lang, 0) + len(grams)
                if size[lang] > 1 << 19:
                    settle(lang)
                    size[lang] = 0
    for lang in sorted(set(sums) | set(pending)):
        settle(lang)
        keys, n = sums[lang]
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(keys[part]), pa.string()),
                    pa.array(keys[part].view(np.int64)),
                    pa.array(n[part].astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )
    C.give_back()


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over all training rows (text, lang)."""
    C.small_batches(training.sparkSession)
    counted = training.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class HashArray:
    """Sorted 64-bit hashes with an index over their leading bits; values by key, all languages side by side."""

    keys: np.ndarray
    index: np.ndarray
    shift: int
    values: np.ndarray
    longest: int

    @classmethod
    def build(cls, grams: np.ndarray, values: np.ndarray) -> HashArray:
        hashed = C.mix(grams)
        order = np.argsort(hashed)
        hashed = hashed[order]
        bits = max(4, int(len(hashed)).bit_length())
        index = np.searchsorted(hashed, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        index = np.r_[index, len(hashed)].astype(np.int64)
        longest = int(np.diff(index).max()) if len(hashed) else 0
        return cls(np.r_[hashed, np.uint64(0)], index, 64 - bits, values[order].astype(np.float32), longest)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Position of every gram, -1 if absent."""
        hashed = C.mix(grams)
        bucket = (hashed >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.index[bucket], self.index[bucket + 1]
        out = np.where((at < end) & (self.keys[np.minimum(at, len(self.keys) - 1)] == hashed), at, -1)
        todo = np.flatnonzero((out < 0) & (at + 1 < end))
        for step in range(1, self.longest):
            if not len(todo):
                break
            spot = at[todo] + step
            hit = self.keys[spot] == hashed[todo]
            out[todo[hit]] = spot[hit]
            todo = todo[~hit]
            todo = todo[at[todo] + step + 1 < end[todo]]
        return out


@dataclass
class Models:
    """Interpolated log-probabilities by order (1 to ORDER) and log back-off weights by context length (1 to ORDER - 1)."""

    languages: list[str]
    grams: list[HashArray]
    backoff: list[HashArray]
    floor: np.ndarray
    mean: np.ndarray
    doc_var: np.ndarray
    char_var: np.ndarray
    limit: np.ndarray

    def log_probabilities(self, padded: np.ndarray) -> np.ndarray:
        """One row per symbol after the first ORDER - 1, one column per language."""
        n = len(padded) - ORDER + 1
        out = np.zeros((n, len(self.languages)), dtype=np.float32)
        todo = np.arange(n)
        top = packed(padded, ORDER)
        for order in range(ORDER, 0, -1):
            mask = np.uint64((1 << (16 * order)) - 1)
            grams = top[todo] & mask if order < ORDER else top
            at = self.grams[order - 1].find(grams)
            found = at >= 0
            out[todo[found]] += self.grams[order - 1].values[at[found]]
            todo, grams = todo[~found], grams[~found]
            if not len(todo):
                return out
            if order > 1:
                at = self.backoff[order - 2].find(grams >> np.uint64(16))
                seen = at >= 0
                out[todo[seen]] += self.backoff[order - 2].values[at[seen]]
        out[todo] += self.floor
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy by text and language, symbols scored) of whole texts."""
        total = np.zeros((len(texts), len(self.languages)))
        lengths = np.zeros(len(texts), dtype=np.int64)
        sizes = np.cumsum([len(t or "") for t in texts])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 18))))
            syms, offsets = symbols(texts[at:end])
            logp = self.log_probabilities(_padded(syms))
            # row i scores symbol i + 1, that is, the i-th behind the opening blank
            sums = np.vstack([np.zeros((1, logp.shape[1])), np.cumsum(logp, axis=0, dtype=np.float64)])
            total[at:end] = sums[offsets[:-1]] - sums[offsets[1:]]
            lengths[at:end] = np.diff(offsets)
            at = end
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(lengths[:, None] > 0, total / lengths[:, None], np.inf), lengths

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) by text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        ce, lengths = self.cross_entropies(texts)
        best = np.argmin(ce, axis=1)
        rows = np.arange(len(texts))
        valid = lengths > 0
        finite = np.where(valid[:, None], ce, 0.0)
        gap = (finite - finite[rows, best][:, None]) * np.minimum(lengths, EVIDENCE)[:, None]
        score = np.where(valid, 1.0 / np.exp(-gap).sum(axis=1), 0.0)
        distance = self.distance(ce[rows, best], best, lengths)
        rejected = ~valid | (distance > self.limit[best])
        names = [self.languages[b] if v else "und" for b, v in zip(best, valid, strict=True)]
        return names, score, rejected

    def distance(self, ce: np.ndarray, lang: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        spread = np.sqrt(self.doc_var[lang] + self.char_var[lang] / np.maximum(lengths, 1))
        with np.errstate(invalid="ignore"):
            return np.where(lengths > 0, (ce - self.mean[lang]) / spread, 0.0)


def _aggregate(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=values, minlength=len(unique))


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], totals: dict[str, tuple], discount: float = DISCOUNT) -> Models:
    """Models from 4-gram counts by language (sorted grams, counts).

    `totals` has, by language and context of the highest order, the count of all its 4-grams and of its distinct ones.
    """
    languages = sorted(counts)
    tables: list[dict[str, tuple]] = [{} for _ in range(ORDER)]
    for lang in languages:
        grams, n = counts[lang]
        tables[ORDER - 1][lang] = grams, n.astype(float)
        for order in range(ORDER - 1, 0, -1):
            # continuation counts: in how many longer grams a gram ends
            upper = tables[order][lang][0]
            tables[order - 1][lang] = _aggregate(upper & np.uint64((1 << (16 * order)) - 1), np.ones(len(upper)))
    alphabet = max(1, len(np.unique(np.concatenate([tables[0][x][0] for x in languages])))) if languages else 1
    uniform = 1.0 / (alphabet + 1)
    arrays, backoffs = [], []
    unions = [np.unique(np.concatenate([tables[o][x][0] for x in languages])) for o in range(ORDER)] if languages else []
    lower = None  # probabilities of the order below, by union gram and language
    for order in range(1, ORDER + 1) if languages else []:
        union = unions[order - 1]
        prob = np.zeros((len(union), len(languages)))
        contexts = np.unique(union >> np.uint64(16))
        weights = np.ones((len(contexts), len(languages)))
        for j, lang in enumerate(languages):
            grams, n = tables[order - 1][lang]
            context = grams >> np.uint64(16)
            if order == ORDER:
                ctx, mass, distinct = totals[lang]
            else:
                ctx, mass = _aggregate(context, n)
                distinct = _aggregate(context, np.ones(len(n)))[1]
            kept = _aggregate(context, np.maximum(n - discount, 0.0))
            share = np.zeros(len(ctx))
            share[np.searchsorted(ctx, kept[0])] = kept[1]
            rest = 1.0 - share / mass  # discounts
            weights[np.searchsorted(contexts, ctx[np.isin(ctx, contexts)]), j] = rest[np.isin(ctx, contexts)]
            at = np.searchsorted(union, grams)
            prob[at, j] = np.maximum(n - discount, 0.0) / mass[np.searchsorted(ctx, context)]
        if order == 1:
            below = np.full((len(union), len(languages)), uniform)
            floor = np.log(weights[0] * uniform)
        else:
            suffix = union & np.uint64((1 << (16 * (order - 1))) - 1)
            below = lower[np.searchsorted(unions[order - 2], suffix)]
            backoffs.append(HashArray.build(contexts, np.log(np.maximum(weights, 1e-12))))
        prob = prob + weights[np.searchsorted(contexts, union >> np.uint64(16))] * below
        arrays.append(HashArray.build(union, np.log(np.maximum(prob, 1e-30))))
        lower = prob
    k = len(languages)
    return Models(languages, arrays, backoffs, floor if languages else np.zeros(0), np.zeros(k), np.ones(k), np.ones(k), np.full(k, np.inf))


def fit(training: DataFrame, scratch: C.Scratch) -> Models:
    """Models of all languages of the rows (text, lang, id)."""
    training = training.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    back = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(HELD_BACK)) == 0
    counted = scratch.write(gram_counts(training.filter(~back)), "grams")
    counts, mass = {}, {}
    for lang in sorted(r["lang"] for r in counted.select("lang").distinct().collect()):
        rows = counted.filter(F.col("lang") == lang).select("gram", "n").toArrow()
        g, n = np.array(rows.column("gram")).view(np.uint64), np.array(rows.column("n"))
        order = np.argsort(g)
        counts[lang] = g[order], n[order]
        context = counts[lang][0] >> np.uint64(16)
        mass[lang] = *_aggregate(context, counts[lang][1]), _aggregate(context, np.ones(len(g)))[1]
    models = kneser_ney(counts, mass)
    if models.languages:
        held = training.filter(back).select("text", "lang").mapInArrow(_held_back(models), "lang int, ce double, length long")
        calibrate(models, scratch.write(held, "back"))
    return models


def calibrate(models: Models, held: DataFrame) -> None:
    """Sets means, deviations and limits from (lang, ce, length) of all texts held back; one row per language comes to the driver.

    The limit of a language is MARGIN times a high quantile of its distances. A language with fewer than two texts
    has the largest limit of all.
    """
    k = len(models.languages)
    models.limit = np.full(k, MARGIN * USUAL)
    own = held.groupBy("lang").agg(F.median("length").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").collect()
    if not own:
        return
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("lang") + 1)
    median = np.full(k, np.inf)
    for r in own:
        median[r["lang"]] = r["m"]
    known = held.filter(of(median) < float("inf"))
    for r in known.filter(F.col("length") >= of(median)).groupBy("lang").agg(F.avg("ce").alias("m"), F.var_pop("ce").alias("v")).collect():
        models.mean[r["lang"]], models.doc_var[r["lang"]] = r["m"], max(r["v"], 1e-4)
    off = (F.col("ce") - of(models.mean)) ** 2 * F.col("length")
    for r in known.groupBy("lang").agg(F.avg(off).alias("v")).collect():
        models.char_var[r["lang"]] = max(r["v"], 1e-2)
    distance = (F.col("ce") - of(models.mean)) / F.sqrt(of(models.doc_var) + of(models.char_var) / F.col("length"))
    # rounded, so that the quantile holds a bounded number of values
    far = known.groupBy("lang").agg(F.percentile(F.round(distance, 3), F.lit(QUANTILE)).alias("d")).collect()
    for r in far:
        models.limit[r["lang"]] = MARGIN * max(USUAL, r["d"])
    models.limit[~np.isfinite(median)] = models.limit.max()


def _held_back(models: Models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: j for j, lang in enumerate(models.languages)}
        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], dtype=np.int64)
            ce, lengths = models.cross_entropies(batch.column(0).to_pylist())
            at = np.flatnonzero((lang >= 0) & (lengths > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[at].astype(np.int32)), pa.array(ce[at, lang[at]]), pa.array(lengths[at])], names=["lang", "ce", "length"]
            )
        C.give_back()

    return run


def _predict(models: Models, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = models.decide(batch.column(text_at).to_pylist())
            keep = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*[batch.schema.names[i] for i in keep], "lang_pred", "score", "rejected"],
            )
        C.give_back()

    return run


def held_out(doc_id: Column) -> Column:
    """Documents that never train: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Models:
    """Models from the rows that are not held out and have an id."""
    C.small_batches(docs.sparkSession)
    rows = docs.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    training = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("id"))
    scratch = C.Scratch(docs.sparkSession, "language")
    models = fit(training, scratch)
    scratch.drop("grams", "back")
    return models


def predicted(docs: DataFrame, models: Models, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A struct `row` of the columns `keep` (default all), lang_pred, score and rejected."""
    C.small_batches(docs.sparkSession)
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    rows = docs.select(kept, F.col(f"`{text}`").cast("string").alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(models, 1), f"row {row_type}, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    out = predicted(docs, train_on(docs), keep=["doc_id"])
    return out.select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is recognised."""
    return predicted(docs, train_on(docs)).filter(~F.col("rejected")).select("row.*")
