"""Mapping arbitrary exports to the standard loan schema, as a column-profiling job.

`long_values` turns exports into (source, position, column, row, value); `profile` aggregates every column of every
export in one job; the match functions then work on one row per column.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.fixed_values import (
    CONTENT_PATTERNS,
    CORE_NAMES,
    ENGINE_PATTERNS,
    ENGINE_STATUS_WORDS,
    FIELD_MEANINGS,
    FURTHER_NAMES,
    PAGE_NAMES,
    PATTERN_FIELDS,
    SEMANTIC_MINIMUM,
    STATUS_WORDS,
)
from ledgerlens.functions.clock import any_date
from ledgerlens.functions.text import (
    ALPHA_WORDS,
    PERSON_NAME,
    TWO_WORDS,
    clean_phone,
    indel_similarity,
    normalise_header,
    string_similarity,
    try_double,
)
from ledgerlens.schema import IMPORTANT_FIELDS, REQUIRED_FIELDS, REQUIRED_TO_ANALYSE, STANDARD_FIELDS

COLUMN_KEY = ["source", "position", "column"]


def name_variations(extended: bool = True) -> dict[str, list[str]]:
    """Known names per field in matching order: all 22 fields, or the twelve the engines know."""
    if not extended:
        return CORE_NAMES
    known = {**CORE_NAMES, **FURTHER_NAMES}
    return {field: known[field] for field in STANDARD_FIELDS}


def _unpivoted(source: str, columns: list[str], wide: DataFrame, ids: list[str]) -> DataFrame:
    """`ids`, source, position, column, value from columns named by position, so that a header may hold any character."""
    long = wide.unpivot(ids, [f"c{i}" for i in range(len(columns))], "_place", "value")
    position = F.substring("_place", 2, 10).cast("int")
    header = F.element_at(F.array(*[F.lit(c) for c in columns]), position + 1)
    return long.select(F.lit(source).alias("source"), position.alias("position"), header.alias("column"), *ids, "value")


def long_values(exports: Mapping[str, DataFrame], order: str | None = None) -> DataFrame:
    """Every non-empty cell as (source, position, column, row, value); `order` names the row-order column."""
    parts = []
    for source, export in exports.items():
        columns = [c for c in export.columns if c != order]
        row = F.col(order) if order else F.monotonically_increasing_id()
        cells = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
        long = _unpivoted(source, columns, export.select(row.cast("long").alias("row"), *cells), ["row"])
        parts.append(long.filter(F.col("value").isNotNull() & (F.trim("value") != "")))
    return reduce(DataFrame.unionByName, parts)


def filled_columns(exports: Mapping[str, DataFrame], order: str | None = None) -> DataFrame:
    """(source, position, column) of every column that holds a non-empty cell: one aggregate row per export, no cell moves."""
    parts = []
    for source, export in exports.items():
        columns = [c for c in export.columns if c != order]
        filled = export.agg(*[F.bool_or(F.trim(F.col(f"`{c}`").cast("string")) != "").alias(f"c{i}") for i, c in enumerate(columns)])
        parts.append(_unpivoted(source, columns, filled, []).filter("value").drop("value"))
    return reduce(DataFrame.unionByName, parts)


def column_sample(cells: DataFrame, n: int = 100) -> DataFrame:
    """The first `n` values of every column. A task keeps `n` per column as its cells pass by, so that nothing else is sorted."""
    order = Window.partitionBy(*COLUMN_KEY).orderBy("row")
    kept = cells.mapInArrow(_first_rows(n), cells.schema)
    return kept.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def _first_rows(n: int):
    """For `mapInArrow` over cells: the `n` cells of smallest row (nulls first) of every column of the task."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple, int] = {}  # of the task's columns
        cut = np.zeros(0, np.int64)  # the row from which on a column's cells are not needed
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []  # cells, the numbers of their columns, their rows
        size = 0

        def settled() -> list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            cells = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
            which, rows = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            order = np.lexsort((rows, which))
            begin = np.flatnonzero(np.r_[True, np.diff(which[order]) > 0])
            counts = np.diff(np.r_[begin, len(order)])
            full = counts >= n
            cut[which[order[begin[full]]]] = rows[order[begin[full] + n - 1]]
            order = order[np.arange(len(order)) - np.repeat(begin, counts) < n]
            return [(b, which[order], rows[order]) for b in cells.take(pa.array(order)).combine_chunks().to_batches()]

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [batch.column(batch.schema.get_field_index(c)).dictionary_encode() for c in COLUMN_KEY]
            codes = [np.asarray(t.indices.fill_null(len(t.dictionary))) for t in texts]
            # a batch holds few columns: their numbers come from one row of each
            joined = codes[0].astype(np.int64)
            for code, text in zip(codes[1:], texts[1:], strict=True):
                joined = joined * (len(text.dictionary) + 1) + code
            _, one, which = np.unique(joined, return_index=True, return_inverse=True)
            keys = [tuple(t[int(i)].as_py() for t in texts) for i in one]
            which = np.array([numbers.setdefault(k, len(numbers)) for k in keys])[which]
            cut = np.r_[cut, np.full(len(numbers) - len(cut), np.iinfo(np.int64).max)]
            row = batch.column(batch.schema.get_field_index("row")).cast(pa.int64())
            known = np.asarray(row.is_valid())
            rows = np.where(known, np.asarray(row.fill_null(0)), np.iinfo(np.int64).min)
            wanted = np.flatnonzero((rows < cut[which]) | (cut[which] == np.iinfo(np.int64).max))
            if not len(wanted):
                continue
            held.append((batch.take(pa.array(wanted)), which[wanted], rows[wanted]))
            size += len(wanted)
            if size > 4 * n * len(numbers) + 20_000:
                held = settled()
                size = sum(len(h[1]) for h in held)
        if held:
            for cells, _, _ in settled():
                yield cells

    return first


def _share(test: Column) -> Column:
    """Share of the cells whose value passes, over distinct values that stand for `cells` cells each."""
    return F.sum(F.when(test, F.col("cells")).otherwise(0)) / F.sum("cells")


def _mean(value: Column) -> Column:
    known = F.when(value.isNotNull(), F.col("cells"))
    return F.try_divide(F.sum(value * F.col("cells")), F.sum(known))


def _digits(value: Column) -> Column:
    return F.regexp_count(value, F.lit("[0-9]"))


def _length_between(value: Column, low: int, high: int) -> Column:
    return F.length(value).between(low, high)


def profile(cells: DataFrame) -> DataFrame:
    """One row per column: size, distinct values, number range, and the share of values that fit each pattern.

    Cells collapse to distinct (column, value) rows before anything is tested: that shuffle is the only one that
    grows with the data, it spreads a huge column over all tasks, and the patterns run once per distinct value.
    Works on whole columns or on `column_sample`.
    """
    distinct = cells.groupBy(*COLUMN_KEY, "value").agg(F.count(F.lit(1)).alias("cells"), F.min("row").alias("row"))
    raw, value = F.col("value"), F.trim("value")
    number = try_double(raw)
    plain = try_double(F.translate("value", ",", ""))
    fraction = F.length(F.regexp_extract("value", r"\.(\d*)$", 1))
    any_of = lambda v, patterns: v.rlike("|".join(patterns))
    cleaned = clean_phone(raw)
    engine_text = {
        "phone": cleaned,
        "nin": F.translate(F.upper("value"), " -", ""),
        "date": raw,
        "time": raw,
        "commas": raw,
    }
    measures = {
        "values": F.sum("cells"),
        "distinct_values": F.count(F.lit(1)),
        "mean_length": _mean(F.length("value")),
        "first_length": F.min_by(F.length("value"), "row"),
        "numeric_share": _share(number.isNotNull()),
        "integer_share": _share(raw.rlike(r"^-?\d+$")),
        "fine_share": _share(fraction > 4),
        "number_min": F.min(number),
        "number_max": F.max(number),
        "number_mean": _mean(number),
        "plain_share": _share(plain.isNotNull()),
        "plain_min": F.min(plain),
        "plain_max": F.max(plain),
        "plain_mean": _mean(plain),
        "date_share": _share(any_date(value).isNotNull()),
        "name_share": _share(raw.rlike(PERSON_NAME)),
        "two_word_share": _share(raw.rlike(TWO_WORDS)),
        "alpha_share": _share(raw.rlike(ALPHA_WORDS)),
        "has_status": F.bool_or(F.lower("value").isin(STATUS_WORDS)),
        "status_share": _share(F.lower("value").rlike("|".join(ENGINE_STATUS_WORDS))),
        "b_phone": _share(_length_between(cleaned, 10, 15) & (_digits(cleaned) >= 9)),
        "b_date": _share(raw.contains("-") & _length_between(raw, 8, 10) & (_digits(raw) >= 6)),
        "b_time": _share(raw.contains(":") & _length_between(raw, 4, 8) & (_digits(raw) >= 3)),
    }
    for kind, patterns in CONTENT_PATTERNS.items():
        measures[f"p_{kind}"] = _share(any_of(value, patterns))
    for kind, (pattern, _, _) in ENGINE_PATTERNS.items():
        measures[f"e_{kind}"] = _share(engine_text[kind].rlike(pattern))
    return distinct.groupBy(*COLUMN_KEY).agg(*[m.alias(n) for n, m in measures.items()])


# --- name matching ----------------------------------------------------------------------------------------------


def _known(variations: Mapping[str, list[str]]) -> Column:
    """The variation list as one constant array of (field, name, place)."""
    entries = [
        {"field": field, "name": name, "place": place}
        for place, (field, name) in enumerate((f, n) for f, names in variations.items() for n in names)
    ]
    return F.from_json(F.lit(json.dumps(entries)), "array<struct<field:string,name:string,place:int>>")


def _contains(header: Column, name: Column, min_length: int = 0) -> Column:
    backward = name.contains(header)
    if min_length:
        backward = backward & (F.length(header) >= min_length)
    return header.contains(name) | backward


def name_match(header: Column, variations: Mapping[str, list[str]] | None = None, min_length: int = 0) -> Column:
    """Best match of a normalised header as (score, place, field): exact 1, contained either way 0.85, else edit ratio.

    Pass a plain column: the header is read once per known name, so an expression would be recomputed as often.
    The first name in list order wins a tie. `min_length` keeps shorter headers from matching inside longer names.
    An expression over a constant array: nothing is joined or shuffled however many headers there are.
    """

    def scored(known: Column) -> Column:
        name = known["name"]
        inside = F.when(_contains(header, name, min_length), 0.85).otherwise(0.0)
        score = F.when(header == name, 1.0).otherwise(F.greatest(inside, string_similarity(header, name)))
        return F.struct(score.alias("score"), (-known["place"]).alias("place"), known["field"].alias("field"))

    scores = F.transform(_known(variations or name_variations()), scored)
    return F.array_max(F.filter(scores, lambda m: m["score"] > 0))


def name_match_indel(headers: DataFrame, column: str = "column", min_length: int = 0) -> DataFrame:
    """Distinct headers with their best field as `name_match`, but by the indel ratio instead of the edit ratio.

    Each header meets the fixed list of known names; the ratio runs in Arrow batches.
    """
    known = F.explode(_known(name_variations())).alias("known")
    pairs = headers.select(column).distinct().select(column, normalise_header(F.col(column)).alias("_h"), known)
    name = F.col("known.name")
    rated = pairs.withColumn("_ratio", indel_similarity(F.col("_h"), name))
    inside = F.when(_contains(F.col("_h"), name, min_length), 0.85).otherwise(0.0)
    score = F.when(F.col("_h") == name, 1.0).otherwise(F.greatest(inside, F.col("_ratio")))
    best = F.max(F.struct(score.alias("score"), (-F.col("known.place")).alias("place"), F.col("known.field").alias("field")))
    return rated.groupBy(column).agg(best.alias("_best")).filter("_best.score > 0").select(
        column, F.col("_best.field").alias("field"), F.col("_best.score").alias("score")
    )


def _engine_names(header: Column) -> Column:
    """Every name the engines accept for a header, as an array of (score, place, field, method)."""

    def scored(known: Column) -> Column:
        name = known["name"]
        similarity = string_similarity(header, name, empty="zero")
        fuzzy = F.when(similarity > 0.7, F.floor(similarity * 100).cast("int")).otherwise(0)
        inside = F.when(_contains(header, name), 85).otherwise(0)
        exact = header == name
        return F.struct(
            F.when(exact, 100).otherwise(F.greatest(inside, fuzzy)).alias("score"),
            (-known["place"]).alias("place"),
            known["field"].alias("field"),
            F.when(exact, "exact_match")
            .when(inside >= fuzzy, "name_match")
            .otherwise("fuzzy_match")
            .alias("method"),
        )

    return F.filter(F.transform(_known(CORE_NAMES), scored), lambda m: m["score"] > 0)


# --- content matching -------------------------------------------------------------------------------------------


def _guess(field: str | None, score: float) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(score).alias("score"))


def pattern_match(minimum: float = 0.5) -> Column:
    """Over a profile row: the kind with the largest share of fitting values, the first kind on a tie."""
    ranked = F.array(
        *[
            F.struct(
                F.col(f"p_{kind}").alias("score"), F.lit(-place).alias("place"), F.lit(PATTERN_FIELDS[kind]).alias("field")
            )
            for place, kind in enumerate(CONTENT_PATTERNS)
        ]
    )
    best = F.array_max(ranked)
    return F.when(best["score"] > minimum, F.struct(best["field"].alias("field"), best["score"].alias("score")))


def statistics_match() -> Column:
    """Over a profile row: the field the value statistics suggest, with its fixed score."""
    low, high, mean = F.col("number_min"), F.col("number_max"), F.col("number_mean")
    fine = F.col("fine_share") > 0.5
    numeric = (
        F.when((low >= 0) & (mean > 10000), _guess("amount", 0.75))
        .when((low >= 0) & (high <= 100), _guess("interest_rate", 0.6))
        .when((low >= 1) & (high <= 360) & (F.col("integer_share") == 1), _guess("term_months", 0.6))
        .when((low >= -90) & (high <= 90) & fine, _guess("latitude", 0.65))
        .when((low >= -180) & (high <= 180) & fine, _guess("longitude", 0.65))
    )
    unique = F.col("distinct_values") / F.col("values") > 0.95
    other = (
        F.when(F.col("date_share") > 0.8, _guess("loan_date", 0.7))
        .when(unique & (F.col("mean_length") < 15), _guess("loan_id", 0.6))
        .when(unique & (F.col("mean_length") < 25), _guess("borrower_id", 0.55))
        .when(F.col("name_share") > 0.7, _guess("borrower_name", 0.7))
        .when(F.col("has_status"), _guess("status", 0.8))
    )
    return F.coalesce(F.when(F.col("numeric_share") > 0.9, numeric), other)


def word_grams(text: Column) -> Column:
    """The distinct runs of three characters of every word, with a blank on either side of it."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, runs)))


def _grams(text: str) -> set[str]:
    return {f" {w} "[i : i + 3] for w in re.split("[^a-z0-9]+", text.lower()) if w for i in range(len(w))}


def semantic_match(header: Column, meanings: Mapping[str, str] = FIELD_MEANINGS) -> Column:
    """(field, score): the field whose meaning is nearest, by the cosine of weighted character trigrams of words.

    A trigram weighs log(1 + fields / fields that hold it), one that no field holds as if one did. Name and meaning of a
    field are one text. The first field in order wins a tie; a text without letters and digits matches none. Words that
    share their stem meet although no name is spelled alike: this stands for sentence vectors.
    """
    texts = {f: _grams(f"{f} {words}") for f, words in meanings.items()}
    held = Counter(g for grams in texts.values() for g in grams)
    weight = {g: math.log(1 + len(texts) / n) for g, n in held.items()}
    # constants read from text are folded once, and one expression goes over all fields
    known = F.from_json(F.lit(json.dumps({g: weight[g] ** 2 for g in sorted(weight)})), "map<string,double>")
    rare = F.lit(math.log(1 + len(texts)) ** 2)
    listed = [
        {"place": -i, "field": f, "grams": sorted(grams), "size": math.sqrt(sum(weight[g] ** 2 for g in grams))}
        for i, (f, grams) in enumerate(texts.items())
    ]
    fields = F.from_json(F.lit(json.dumps(listed)), "array<struct<place:int,field:string,grams:array<string>,size:double>>")
    total = lambda grams: F.aggregate(
        F.transform(grams, lambda g: F.coalesce(F.try_element_at(known, g), rare)), F.lit(0.0), lambda t, w: t + w
    )
    own = word_grams(header)

    def scored(f: Column) -> Column:
        cosine = total(F.array_intersect(own, f["grams"])) / (F.sqrt(total(own)) * f["size"])
        return F.struct(F.round(cosine, 9).alias("score"), f["place"].alias("place"), f["field"].alias("field"))

    best = F.array_max(F.transform(fields, scored))
    return F.when(F.size(own) > 0, F.struct(best["field"].alias("field"), best["score"].alias("score")))


def detect(profiles: DataFrame, stats_minimum: float = 0.6, min_length: int = 0) -> DataFrame:
    """One candidate per column: strong name, content pattern, statistics, weak name, meaning, in that order."""
    headed = profiles.withColumn("_header", normalise_header(F.col("column")))
    matched = headed.withColumns(
        {
            "_name": name_match(F.col("_header"), min_length=min_length),
            "_pattern": pattern_match(),
            "_stats": statistics_match(),
            "_meant": semantic_match(F.col("_header")),
        }
    )
    name, pattern, stats, meant = F.col("_name"), F.col("_pattern"), F.col("_stats"), F.col("_meant")

    def found(match: Column, method: str) -> Column:
        return F.struct(
            match["field"].alias("standard"),
            match["score"].cast("double").alias("confidence"),
            F.lit(method).alias("method"),
        )

    choice = (
        F.when(name["score"] > 0.8, found(name, "name_matching"))
        .when(pattern["score"] > 0.7, found(pattern, "pattern_detection"))
        .when(stats["score"] > stats_minimum, found(stats, "statistical_analysis"))
        .when(name["score"] > 0.5, found(name, "name_matching_low"))
        .when(meant["score"] > SEMANTIC_MINIMUM, found(meant, "semantic_matching"))
    )
    return matched.withColumn("_choice", choice).select(*COLUMN_KEY, "_choice.*")


def resolve(candidates: DataFrame) -> DataFrame:
    """One column per standard field and source: the most confident, the leftmost on a tie; losers are unmapped."""
    order = Window.partitionBy("source", "standard").orderBy(F.desc("confidence"), "position")
    won = F.col("standard").isNotNull() & (F.row_number().over(order) == 1)
    ranked = candidates.withColumn("_won", won)
    return ranked.select(
        *COLUMN_KEY, *[F.when(F.col("_won"), F.col(c)).alias(c) for c in ("standard", "confidence", "method")]
    )


def _engine_pattern_a() -> Column:
    choice: Column | None = None
    for kind, (_, field, confidence) in ENGINE_PATTERNS.items():
        test, value = F.col(f"e_{kind}") > 0.7, _guess(field, confidence)
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    return choice


def _engine_pattern_b() -> Column:
    return (
        F.when(F.col("b_phone") > 0.7, _guess("phone", 90))
        .when(F.col("b_date") > 0.7, _guess("loan_date", 85))
        .when(F.col("b_time") > 0.7, _guess("approval_time", 80))
    )


def _engine_statistics(edition: str) -> Column:
    low, high, mean = F.col("plain_min"), F.col("plain_max"), F.col("plain_mean")
    numeric = F.when((low >= 0) & (mean > 100000), _guess("amount", 75)).when(
        (low >= 0) & (high <= 100) & (mean < 50), _guess("interest_rate", 60)
    )
    if edition == "a":
        numeric = numeric.when((low >= 1) & (high <= 360), _guess("term_months", 55))
    unique = F.col("distinct_values") / F.col("values") > 0.95
    names = F.col("two_word_share") if edition == "a" else F.col("alpha_share")
    words = F.when(names > 0.7, _guess("borrower_name", 70)).when(F.col("status_share") > 0.5, _guess("status", 80))
    if edition == "a":
        words = F.coalesce(F.when(unique & (F.col("first_length") < 15), _guess("loan_id", 60)), words)
    return F.coalesce(F.when(F.col("plain_share") > 0.9, numeric), words)


def detect_engine(profiles: DataFrame) -> DataFrame:
    """One candidate per column: the best of name and pattern, statistics only when neither found anything."""
    headed = profiles.withColumn("_header", normalise_header(F.col("column"), "engine"))
    best = F.array_max(_engine_names(F.col("_header")))
    matched = headed.withColumns(
        {"_name": best, "_pattern": _engine_pattern_a(), "_stats": _engine_statistics("a")}
    )
    name, pattern, stats = F.col("_name"), F.col("_pattern"), F.col("_stats")

    def found(match: Column, method: Column) -> Column:
        return F.struct(
            match["field"].alias("standard"), match["score"].cast("int").alias("confidence"), method.alias("method")
        )

    named = F.coalesce(name["score"], F.lit(0))
    choice = (
        F.when(named == 100, found(name, name["method"]))
        .when(pattern["score"] > named, found(pattern, F.lit("pattern")))
        .when(named > 0, found(name, name["method"]))
        .when(stats.isNotNull(), found(stats, F.lit("statistics")))
    )
    accepted = F.when(choice["confidence"] > 40, choice)
    return matched.withColumn("_choice", accepted).select(*COLUMN_KEY, "_choice.*")


def pooled_candidates(profiles: DataFrame) -> DataFrame:
    """All name, pattern and statistics candidates above 40 of every column, each with its rank fields."""
    headed = profiles.withColumn("_header", normalise_header(F.col("column"), "engine"))
    names = F.transform(
        _engine_names(F.col("_header")),
        lambda m: F.struct(m["field"].alias("standard"), m["score"].alias("confidence"), m["method"].alias("method")),
    )

    def single(match: Column, method: str) -> Column:
        entry = F.struct(
            match["field"].alias("standard"),
            match["score"].cast("int").alias("confidence"),
            F.lit(method).alias("method"),
        )
        return F.filter(F.array(entry), lambda e: e["standard"].isNotNull())

    every = F.concat(names, single(_engine_pattern_b(), "pattern"), single(_engine_statistics("b"), "statistics"))
    return (
        headed.select(*COLUMN_KEY, F.posexplode(every).alias("place", "c"))
        .select(*COLUMN_KEY, "place", "c.*")
        .filter(F.col("confidence") > 40)
    )


_ASSIGNED = "source string, position int, column string, standard string, confidence int, method string"


def assign_pooled(candidates: DataFrame) -> DataFrame:
    """One-to-one assignment per export by falling confidence. A group is one export's candidate list, whose size
    depends on the number of its columns, not of its rows."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["confidence", "position", "place"], ascending=[False, True, True])
        columns: set[str] = set()
        fields: set[str] = set()
        kept = []
        for row in ordered.itertuples(index=False):
            if row.column not in columns and row.standard not in fields:
                columns.add(row.column)
                fields.add(row.standard)
                kept.append(row)
        return pd.DataFrame(kept, columns=pdf.columns).drop(columns="place")

    return candidates.groupBy("source").applyInPandas(assign, _ASSIGNED)


def assign_first(headers: DataFrame, variations: Mapping[str, list[str]] = PAGE_NAMES, both_ways: bool = False) -> DataFrame:
    """Columns in order, fields in order, the first free field with a known name inside the header (or, with
    `both_ways`, around it): 100 when equal, else 85. `headers` has (source, position, column)."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        rows = []
        for item in pdf.sort_values("position").itertuples(index=False):
            header, hit = item.header, None
            for field, names in variations.items():
                matches = [n for n in names if n in header or (both_ways and header in n)]
                if matches and field not in taken:
                    hit = (field, 100 if matches[0] == header else 85, "name_match")
                    taken.add(field)
                    break
            rows.append((item.source, item.position, item.column, *(hit or (None, 0, "none"))))
        return pd.DataFrame(rows, columns=["source", "position", "column", "standard", "confidence", "method"])

    named = headers.select(*COLUMN_KEY, normalise_header(F.col("column"), "page").alias("header"))
    return named.groupBy("source").applyInPandas(assign, _ASSIGNED)


def override(mappings: DataFrame, overrides: Mapping[str, str], confidence: float = 1.0) -> DataFrame:
    """Manual choices (column -> field) replace detected ones and free the field from other columns."""
    if not overrides:
        return mappings
    chosen = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    manual = F.try_element_at(chosen, F.col("column"))
    freed = F.col("standard").isin(list(overrides.values()))
    replaced = {
        "standard": F.coalesce(manual, F.when(~freed, F.col("standard"))),
        "confidence": F.when(manual.isNotNull(), confidence).otherwise(F.when(~freed, F.col("confidence"))),
        "method": F.when(manual.isNotNull(), "manual").otherwise(F.when(~freed, F.col("method"))),
    }
    return mappings.select(*COLUMN_KEY, *[value.alias(name) for name, value in replaced.items()])


def mapping_report(mappings: DataFrame) -> DataFrame:
    """Per source: column counts, the mappings in order of the column, how often each method was used, found required and
    important fields, and whether analysis can start. A source has as many rows as its export has columns."""
    fields = F.collect_set("standard").alias("_fields")
    counted = mappings.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count("standard").alias("mapped_columns"),
        F.count_if(F.col("standard").isNull()).alias("unmapped_columns"),
        fields,
        F.array_join(F.sort_array(F.collect_list("method")), ",").alias("methods"),
        F.sort_array(F.collect_list(F.when(F.col("standard").isNotNull(), F.concat_ws("=", "column", "standard")))).alias("_pairs"),
        F.sort_array(F.collect_list("method")).alias("_used"),
    )
    used = F.transform(
        F.array_distinct("_used"),
        lambda m: F.concat_ws(":", m, F.size(F.filter("_used", lambda x: x == m)).cast("string")),
    )
    has = lambda f: F.array_contains("_fields", f)
    listed = lambda names: F.array_join(F.array(*[F.when(has(f), f) for f in names]), ",")
    return counted.select(
        "source",
        "total_columns",
        "mapped_columns",
        "unmapped_columns",
        "methods",
        F.array_join("_pairs", ",").alias("mappings"),
        F.array_join(used, ",").alias("method_histogram"),
        listed(REQUIRED_FIELDS).alias("required_found"),
        listed(IMPORTANT_FIELDS).alias("important_found"),
        reduce(lambda a, b: a & b, [has(f) for f in REQUIRED_TO_ANALYSE]).alias("can_analyze"),
    )


def nearest_by_cosine(
    vectors: DataFrame, references: Column, minimum: float = 0.5, vector: str = "vector"
) -> DataFrame:
    """The most similar reference per vector when its cosine exceeds `minimum`.

    `references` is one array of (name, vector) structs (a field list, a fixed number of entries): each row scores
    it in place, so nothing is joined.
    """
    product = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
    size = lambda v: F.sqrt(product(v, v))
    own = F.col(vector)

    def scored(reference: Column) -> Column:
        cosine = F.try_divide(product(own, reference["vector"]), size(own) * size(reference["vector"]))
        return F.struct(cosine.alias("score"), reference["name"].alias("name"))

    best = F.array_max(F.filter(F.transform(references, scored), lambda m: m["score"] > minimum))
    return (
        vectors.withColumn("_best", best)
        .withColumns({"match": F.col("_best.name"), "score": F.col("_best.score")})
        .drop("_best")
    )
