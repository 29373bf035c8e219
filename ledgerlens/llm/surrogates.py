"""Surrogates for personal data, in DataFrame operations only.

Detected entities are replaced by others of their kind: what a person, number or address becomes depends on a key
and on the normalised entity alone, so every mention gets the same surrogate (`+1 (743) 555-3824` and `+17435553824` are
one number, `Ms Smith` and `Anna Smith` share the family name). Formats stay: punctuation, length and country code of
phones, the check digit of valid card numbers, dotted addresses, the marks that keys begin with, letter case, title and
script of names.

Names: a title shows a name first. A given name is one entity whatever the title before it; its gender is what the
titles of the whole table tell (a form of neither gender where they tell none or both). A full name that the table
shows with a title is found without one in every text, and its single words of three letters or more are found in the
texts that hold the full name or a titled one; a word that is a family name there is one. Titles and words like AND are no names.
A number with and without its country code are two entities, since the code alone does not tell that they are one.

Collision check: the distinct entities of the whole table are one table. Two entities of a kind with one surrogate, or
a surrogate that is itself an entity of the table, are drawn again with the next attempt, all but the first holder,
until none is left. Only the entities that needed another attempt are joined back to their documents.

Scale: the texts are scanned twice, and once more for names without a title where the table has full names; what that
scan sends on are pairs and triples of capitalised words, joined with the full names. The texts are not shuffled, unless the table of
texts that hold a name or an entity that was drawn again outgrows Spark's broadcast threshold. Entities are combined
before their shuffle, so an address in a third of all documents is one row per task, and dealt out before surrogates are drawn.

Edge cases: a null text stays null with no entity, an empty one empty; repeated rows get equal results; null ids are
values; all columns other than the text are carried along under their own names inside `row`; the collision rounds
end because an attempt beyond the third lengthens a surrogate whose form leaves too few choices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch

# Titles before a name, by the gender they tell. They, and the names of secrets, are read in any letter case.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа|г-жа|κυρία"
MALE = "Mr|Herr|Monsieur|Señor|Sr|господин|г-н|κύριος"
NEUTRAL = "Dr|Prof"

TITLES = f"{FEMALE}|{MALE}|{NEUTRAL}"
#: Words in capitals that join names but are none.
JOINING = "and|or|und|oder|et|ou|και"

# Every entity begins where no letter or digit stands before it; each alternative fails on its first characters elsewhere.
WORD = rf"(?!(?iu:{JOINING}|{TITLES})(?!\p{{L}}))\p{{Lu}}\p{{L}}{{1,30}}"
NAME = rf"(?iu:(?=[MFSHDPгκ])(?:{TITLES}))\.? {WORD}(?:[ -]{WORD}){{0,2}}"
TITLE = rf"^(?iu:{TITLES})\.? "
EMAIL = r"[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
ADDRESS = rf"(?<!\.)(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
PHONE = (
    r"(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|(?<![.,-])0[1-9]\d{1,3}[ /-]\d{3,4}[ -]?\d{3,4})(?!\d)"
)
CARD = r"(?<!\.)(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|\d{4}[ -]?\d{6}[ -]?\d{5})(?!\d)"
NATIONAL = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"
ACCOUNT = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAMED = r"(?i:token|secret|password|passwd|pwd|api_?key) {0,2}[=:] {0,2}[\"']?"
#: A named secret has 16 characters or more, or 8 with a digit among them.
SECRET = rf"(?=[tspaTSPA]){NAMED}(?:[A-Za-z0-9_+/=-]{{16,128}}|(?=[A-Za-z_+/=!@#$%^&*-]{{0,15}}\d)[A-Za-z0-9_+/=!@#$%^&*-]{{8,128}})"
# What access keys begin with, and their lengths after it.
MARK = "(?:AKIA|ASIA|AIza|ghp_|gho_|glpat-|sk_live_|xoxb-|xoxp-)"
ACCESS = (
    r"(?=[Agsx])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[po]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}"
    r"|sk_live_[A-Za-z0-9]{24,64}|xox[bp]-[A-Za-z0-9-]{20,128})(?![A-Za-z0-9])"
)
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join([SECRET, ACCESS, NAME, ACCOUNT, CARD, PHONE, NATIONAL, ADDRESS, EMAIL]) + ")"
#: Two or three capitalised words from every place on (group 1): a name without a title may stand there.
CAPITALISED = r"(?<![\p{L}\p{N}])(?=(\p{Lu}\p{L}{1,30}(?:[ -]\p{Lu}\p{L}{1,30}){1,2})(?![\p{L}\p{N}]))"

KINDS = ("email", "address", "card", "phone", "national", "account", "name", "secret")
# Letters that syllables are made of, and how a woman's, a man's and a family's name end.
LATIN = ("bdfgklmnprstvz", "aeiou", "na", "n", "son")
CYRILLIC = ("бвгдзклмнпрстф", "аеиоу", "на", "н", "ко")
GREEK = ("βγδζκλμνπρστφχ", "αεηιο", "να", "ς", "ου")


def _letters(script: tuple[str, ...]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("consonants", "vowels", "female", "male", "family"), script, strict=True)])


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, the value being one variable: computed once and one node of the plan, however often it is read."""
    return F.transform(F.array(value), use)[0]


def found_in(text: Column, pattern: Column | None = None) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN) if pattern is None else pattern, F.lit(0))


def kind_of(m: Column) -> Column:
    """The kind of an entity, from its form (the patterns exclude each other in this order); a name may lack its title."""
    is_ = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(is_(SECRET) | is_(ACCESS), "secret")
        .when(is_(EMAIL), "email")
        .when(is_(CARD), "card")
        .when(is_(PHONE), "phone")
        .when(is_(NATIONAL), "national")
        .when(is_(ADDRESS), "address")
        .when(is_(ACCOUNT), "account")
        .otherwise("name")
    )


def _untitled(m: Column) -> Column:
    return F.regexp_replace(m, TITLE, "")


def _pattern_with(names: Column) -> Column:
    """PATTERN, or one of the names (lower case) or of their words of three letters or more, beginning with a capital."""
    words = F.filter(F.flatten(F.transform(names, lambda n: F.split(n, "[ -]"))), lambda w: F.length(w) > 2)
    known = F.array_distinct(F.concat(names, words))
    longest = F.reverse(F.array_sort(F.transform(known, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    either = F.array_join(F.transform(longest, lambda x: F.regexp_replace(x["w"], "[ -]", "[ -]")), "|")
    bare = F.concat(F.lit(r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), either, F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(known) > 0, F.concat(F.lit(PATTERN), bare)).otherwise(F.lit(PATTERN))


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.", "")
    return F.when(bare.rlike(f"(?iu)^(?:{FEMALE})$"), "f").when(bare.rlike(f"(?iu)^(?:{MALE})$"), "m").otherwise("n")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def atoms(m: Column, names: Column | None = None) -> Column:
    """The parts of an entity that are mapped on their own: (kind, norm, gender) of the whole, or of every word of a name.

    A word that stands alone without a title is a family name if it ends one of `names`, else a given name.
    """
    digits = F.regexp_replace(m, r"\D", "")
    families = F.transform(F.array().cast("array<string>") if names is None else names, lambda n: F.element_at(F.split(n, "[ -]"), -1))
    titled = m.rlike(TITLE)
    gender = F.when(titled, _gender(F.substring_index(m, " ", 1))).otherwise("n")

    def named(words: Column) -> Column:
        def part(w: Column, i: Column) -> Column:
            last = (i == F.size(words) - 1) & (titled | (F.size(words) > 1) | F.array_contains(families, F.lower(w)))
            one = lambda family: F.struct(
                F.concat_ws(":", F.when(family, "family").otherwise("given"), _script(w)).alias("kind"),
                F.lower(w).alias("norm"),
                F.when(family, F.lit("n")).otherwise(gender).alias("gender"),
            )
            return _with(last, one)

        return F.transform(words, part)

    def of_kind(kind: Column) -> Column:
        norm = (
            F.when(kind.isin("card", "phone", "national"), digits)
            .when(kind == "email", F.lower(m))
            .when(kind == "account", F.regexp_replace(m, " ", ""))
            .when(kind == "secret", F.regexp_replace(m, f"^(?:{NAMED})?(?:{MARK})?", ""))
            .otherwise(m)
        )
        whole = F.array(F.struct(kind.alias("kind"), norm.alias("norm"), F.lit("n").alias("gender")))
        return F.when(kind == "name", _with(F.split(_untitled(m), "[ -]"), named)).otherwise(whole)

    return _with(kind_of(m), of_kind)


def _hash(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that only the key's holder can derive from an entity."""
    one = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm)
    return F.concat(F.sha2(one, 256), F.sha2(F.concat(F.lit(f"{key}|more|"), one), 256))


def _byte(h: Column, i: int | Column) -> Column:
    """Byte `i` of a hash as a number."""
    return F.conv(F.substr(h, F.lit(1) + 2 * (F.lit(i) if isinstance(i, int) else i), F.lit(2)), 16, 10).cast("int")


def _like(norm: Column, h: Column, keep: Column) -> Column:
    """`norm` with digits for digits and letters for letters; the first `keep` characters stay."""
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm), F.lit(1))), lambda i: F.substr(norm, i, F.lit(1)))

    hexadecimal, upper_hexadecimal = norm.rlike("^[0-9a-f]{16,}$"), norm.rlike("^[0-9A-F]{16,}$")

    def draw(c: Column, i: Column) -> Column:
        n = _byte(h, i % 64)
        pick = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), pick("0123456789"))
            .when(c.rlike("[A-F]") & upper_hexadecimal, pick("ABCDEF"))
            .when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike("[a-f]") & hexadecimal, pick("abcdef"))
            .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, draw), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)
    terms = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(
            (n - i) % 2 == 1,
            F.element_at(F.array(*[F.lit((2 * d) // 10 + (2 * d) % 10) for d in range(10)]), F.substr(digits, i, F.lit(1)).cast("int") + 1),
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(terms, F.lit(0), lambda t, x: t + x) % 10


def _syllables(h: Column, n: int, script: Column, at: int = 0) -> Column:
    parts = []
    for k in range(n):
        for j, group in enumerate(("consonants", "vowels")):
            parts.append(F.substr(script[group], _byte(h, at + 2 * k + j) % F.length(script[group]) + 1, F.lit(1)))
    return F.concat(*parts)


def surrogate(key: str, kind: Column, norm: Column, attempt: Column, gender: Column) -> Column:
    """The normalised surrogate of a normalised entity; the gender is read for given names."""
    entity = F.struct(kind.alias("kind"), norm.alias("norm"), attempt.alias("attempt"), gender.alias("gender"))
    return _with(entity, lambda e: _with(_hash(key, e["kind"], e["norm"], e["attempt"]), lambda h: _drawn(e, h)))


def _drawn(e: Column, h: Column) -> Column:
    """The surrogate of an entity (kind, norm, attempt, gender) from its hash."""
    kind, norm, attempt, gender = (e[c] for c in ("kind", "norm", "attempt", "gender"))
    longer = F.when(attempt > 3, F.substr(F.translate(h, "abcdef", "012345"), F.lit(1), attempt)).otherwise("")
    code = F.when(norm.startswith("0"), 2).when(F.length(norm) > 10, F.length(norm) - 10).otherwise(0)
    stays = F.when(kind == "phone", code).when(kind == "card", 1).when(kind == "account", 2).otherwise(0)
    like = _like(F.when(kind == "email", F.substring_index(norm, "@", 1)).otherwise(norm), h, stays)

    def checked(digits: Column) -> Column:
        check = F.when(_luhn(norm) == 0, (10 - _luhn(F.concat(digits, F.lit("0")))) % 10).otherwise(_byte(h, 63) % 10)
        return F.concat(digits, check.cast("string"))

    def named(script: Column) -> Column:
        family = kind.startswith("family")
        end = F.when(family, script["family"]).when(gender == "f", script["female"]).when(gender == "m", script["male"]).otherwise("")
        third = F.when(family, _syllables(h, 1, script, 10)).otherwise("")
        return F.concat(_syllables(h, 2, script), third, F.when(attempt > 3, _syllables(h, 2, script, 20)).otherwise(""), end)

    top = F.when(norm.rlike(r"\.(com|net|org)$"), F.substring_index(norm, ".", -1)).otherwise("org")
    script = F.when(kind.endswith("cyrillic"), _letters(CYRILLIC)).when(kind.endswith("greek"), _letters(GREEK)).otherwise(_letters(LATIN))
    return (
        F.when(kind == "email", F.concat(like, longer, F.lit("@mail"), _byte(h, 62) % 10, F.lit(".example."), top))
        .when(kind == "card", _with(F.substr(like, F.lit(1), F.length(norm) - 1), checked))
        .when(kind == "address", F.concat_ws(".", F.lit("10"), _byte(h, 0), _byte(h, 1), _byte(h, 2)))
        .when(kind == "secret", F.concat(like, longer))
        .when(kind.contains(":"), _with(script, named))
        .otherwise(like)
    )


def _laid_out(m: Column, digits: Column) -> Column:
    """The digits in the places that the digits of `m` take; the text around them stays."""
    chars = F.split(m, "")
    seen = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), r"\D", ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, seen(i), F.lit(1))).otherwise(c)), "")


def replacement(key: str, m: Column, notes: Column, names: Column) -> Column:
    """What stands for the entity `m`; `notes` maps "kind|norm" to attempt and gender where they are not 0 and n."""

    def drawn(a: Column) -> Column:
        note = F.try_element_at(notes, F.concat_ws("|", a["kind"], a["norm"]))
        given = F.coalesce(note, F.struct(F.lit(0).alias("attempt"), F.lit("n").alias("gender")))
        return _with(given, lambda n: surrogate(key, a["kind"], a["norm"], n["attempt"], n["gender"]))

    def cased(w: Column, s: Column) -> Column:
        return F.when(w == F.upper(w), F.upper(s)).otherwise(F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.substr(s, F.lit(2), F.length(s))))

    def put(kind: Column, parts: Column) -> Column:
        bare = _untitled(m)
        marks = F.split(F.regexp_replace(bare, "[^ -]+", "x"), "x")
        words = F.zip_with(F.split(bare, "[ -]"), parts, cased)
        spaced = F.zip_with(F.slice(marks, F.lit(1), F.size(parts)), words, lambda a, b: F.concat(a, b))
        first = F.element_at(parts, 1)
        return (
            F.when(kind == "name", F.concat(F.regexp_extract(m, TITLE, 0), F.array_join(spaced, "")))
            .when(kind.isin("card", "phone", "national"), _laid_out(m, first))
            .when(kind == "secret", F.concat(F.regexp_extract(m, f"^(?:{NAMED})?(?:{MARK})?", 0), first))
            .when(kind == "email", F.when(m == F.upper(m), F.upper(first)).otherwise(first))
            .otherwise(first)
        )

    return _with(F.transform(atoms(m, names), drawn), lambda parts: _with(kind_of(m), lambda kind: put(kind, parts)))


def _keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text: equal texts hold equal entities."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(29), text).alias("k2")]


def _dealt(entities: DataFrame) -> DataFrame:
    """The rows over as many tasks as shuffles have: few bytes, but much work each."""
    return entities.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mentions_of(docs: DataFrame, scratch: Scratch, text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(k1, k2, kind, norm, gender) of the distinct entities of every text, and (k1, k2, names) of texts with names, if any.

    The names are in lower case. A text has those that a title shows in it, and the full names of the whole table.
    """
    body = F.col(f"`{text}`")
    found = docs.select(*_keys(body), F.array_distinct(found_in(body)).alias("found")).filter(F.size("found") > 0)
    found = scratch.write(found, "found")
    each = found.select("k1", "k2", F.explode("found").alias("m"))
    parts = each.select("k1", "k2", F.explode(atoms(F.col("m"))).alias("a")).select("k1", "k2", "a.*")
    bare = F.regexp_replace(F.lower(_untitled(F.col("m"))), "-", " ")
    titled = scratch.write(each.filter(F.col("m").rlike(f"^{NAME}$")).select("k1", "k2", bare.alias("name")), "titled")
    if titled.isEmpty():
        return scratch.write(parts, "mentions"), None
    people = scratch.write(titled.filter(F.col("name").contains(" ")).select("name").distinct(), "people")
    runs = F.transform(F.regexp_extract_all(body, F.lit(CAPITALISED), F.lit(1)), lambda r: F.split(F.lower(r), "[ -]"))
    lengths = [F.transform(runs, lambda r: F.array_join(F.slice(r, 1, 2), " ")), F.transform(runs, lambda r: F.array_join(r, " "))]
    shown = docs.select(*_keys(body), F.explode(F.array_distinct(F.concat(*lengths))).alias("name"))
    shown = shown.join(people, "name", "left_semi").select("k1", "k2", "name")
    named = scratch.write(shown.unionByName(titled).distinct(), "named")
    again = named.filter(F.col("name").contains(" ")).select("k1", "k2", F.explode(atoms(F.initcap("name"))).alias("a"))
    again = again.select("k1", "k2", "a.*")
    names = named.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return scratch.write(parts.unionByName(again), "mentions"), scratch.write(names, "names")


def notes_needed(mentions: DataFrame, key: str, scratch: Scratch, rounds: int = 50) -> DataFrame | None:
    """(kind, norm, attempt, gender) of entities drawn again and of given names with a gender; None if there are none."""
    told = lambda g: F.max(F.col("gender") == g)
    known = mentions.groupBy("kind", "norm").agg(told("f").alias("f"), told("m").alias("m"))
    gender = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n")
    known = scratch.write(known.select("kind", "norm", gender.alias("gender")), "entities")
    drawn = _dealt(known).withColumn("attempt", F.lit(0))
    first = surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"), F.col("gender"))
    drawn = scratch.write(drawn.withColumn("s", first), "drawn0")
    for i in range(1, rounds):
        originals = known.select(F.col("kind"), F.col("norm").alias("s")).withColumn("real", F.lit(True))
        held = drawn.groupBy("kind", "s").agg(F.min(F.struct("attempt", "norm")).alias("holder"))
        judged = drawn.join(held, ["kind", "s"]).join(originals, ["kind", "s"], "left")
        again = F.col("real").isNotNull() | (F.struct("attempt", "norm") != F.col("holder"))
        judged = judged.select("kind", "norm", "gender", "attempt", "s", F.coalesce(again, F.lit(False)).alias("again"))
        judged = scratch.write(judged, f"judged{i}")
        if judged.filter("again").isEmpty():
            noted = drawn.filter("attempt > 0 or gender != 'n'").select("kind", "norm", "attempt", "gender")
            return None if noted.isEmpty() else noted
        attempt = F.when(F.col("again"), F.lit(i)).otherwise(F.col("attempt"))
        fresh = surrogate(key, F.col("kind"), F.col("norm"), attempt, F.col("gender"))
        s = F.when(F.col("again"), fresh).otherwise(F.col("s")).alias("s")
        drawn = scratch.write(judged.select("kind", "norm", "gender", attempt.alias("attempt"), s), f"drawn{i}")
        scratch.drop(f"judged{i}", f"drawn{i - 1}")
    raise RuntimeError("surrogates still collide")


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`row` (all columns of `docs` with the text replaced), found (the entities' kinds in order)."""
    scratch = Scratch(docs.sparkSession, "surrogates")
    mentions, names = mentions_of(docs, scratch, text)
    noted = notes_needed(mentions, key, scratch)
    no_notes = F.create_map().cast("map<string,struct<attempt:int,gender:string>>")
    no_names = F.array().cast("array<string>")
    body = F.col(f"`{text}`")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(columns, body.alias("text"))
    tables = []
    if noted is not None:
        entry = F.struct(F.concat_ws("|", "kind", "norm").alias("e"), F.struct("attempt", "gender").alias("note"))
        pairs = mentions.select("k1", "k2", "kind", "norm").distinct().join(noted, ["kind", "norm"]).select("k1", "k2", entry.alias("e"))
        tables.append(pairs.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set("e")).alias("notes")))
    if names is not None:
        tables.append(names)
    if tables:
        of_text = scratch.write(tables[0] if len(tables) == 1 else tables[0].join(tables[1], ["k1", "k2"], "full"), "of_text")
        rows = rows.select("*", *_keys(F.col("text"))).join(of_text, ["k1", "k2"], "left")
    rows = rows.withColumn("notes", no_notes if noted is None else F.coalesce("notes", no_notes))
    rows = rows.withColumn("names", no_names if names is None else F.coalesce("names", no_names))
    pattern = F.lit(PATTERN) if names is None else _pattern_with(F.col("names"))
    rows = rows.withColumn("found", found_in(F.col("text"), pattern))
    around = F.split("text", pattern, -1)
    swapped = F.transform("found", lambda m: replacement(key, m, F.col("notes"), F.col("names")))
    whole = F.array_join(F.zip_with(around, swapped, lambda a, s: F.concat(a, F.coalesce(s, F.lit("")))), "")
    out = F.when(F.size("found") > 0, whole).otherwise(F.col("text"))
    return rows.select(
        F.col("row").withField(f"`{text}`", out).alias("row"),
        F.coalesce(F.transform("found", kind_of), F.array().cast("array<string>")).alias("found"),
    )


def _is(kind: str):
    return lambda k: k == kind


def surrogate_report(docs: DataFrame, key: str = "ledgerlens") -> DataFrame:
    """Per document: doc_id, the text with surrogates, n_entities and the number of each kind."""
    out = pseudonymised(docs.select("doc_id", "text"), key)
    counts = [F.size(F.array_remove(F.transform("found", _is(kind)), False)).alias(f"n_{kind}") for kind in KINDS]
    return out.select("row.doc_id", "row.text", F.size("found").alias("n_entities"), *counts)
