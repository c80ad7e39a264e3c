"""Surrogates for personal data, in DataFrame operations only.

Detected entities get keyed replacements of their own type and format: e-mail addresses (the name and the domain apart, so that
the same domain is always the same one), telephone, card and social security numbers (cards keep their issuer digit and whether
their check digit holds), IPv4 addresses, secrets (hexadecimal stays hexadecimal), and names after a title (gender and script
kept, first and last names apart, so that "Ms Ada Byron" and "Ms Byron" stay one person). A replacement depends on the key, the
type and the normalised entity alone, so all mentions of an entity agree. The distinct entities of the corpus are gathered and
checked: a replacement that two entities share, or that is a real entity of the corpus, is drawn anew with the next attempt
number until there is none. Only entities with an attempt number above 0 go back to the texts, as a scalar map up to
``MAP_ENTRIES`` and by a join on the text's digest beyond that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlens.llm.common import Scratch, fresh

MAP_ENTRIES = 2048
#: From this attempt on, replacements of short e-mail names and of names get longer.
LONGER_FROM = 3
#: Drawings, at most: where a short format has as many entities as numbers, not all can be told apart.
MAX_ROUNDS = 24
#: A text with more than 1 in so many of all rows, and more than ``LARGE_ROWS``, is joined by broadcast.
LARGE_TEXTS, LARGE_ROWS = 10_000, 200
#: Stands around mentions while a text is taken apart.
MARK = "\u0001"
#: Domains that documentation uses; they are nobody's and stay.
RESERVED = ["example.com", "example.org", "example.net"]

#: Titles by gender, and letters and syllables by script: fixed lists.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Señora", "Г-жа"]
MALE_TITLES = ["Mr", "Herr", "Señor", "Г-н"]
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшщэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
LATIN_SYLLABLES = ["ba", "den", "fi", "gor", "hal", "je", "kar", "lin", "mo", "nel", "os", "pra", "ri", "sten", "tu", "val"]
CYRILLIC_SYLLABLES = ["ба", "ве", "гор", "де", "жан", "зи", "кол", "ле", "мир", "но", "пет", "ра", "свет", "то", "фе", "юр"]

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
PHONE = r"(?<![\w+])(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-])"
SSN = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])"
SECRET = r"""(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])|(?<=(?i:token|password|secret|api_key)\s{0,2}[=:]\s{0,2}["']?)(?=[\p{L}\p{N}_/+-][\p{L}\p{N}_/+.=-]{6,}[\p{L}\p{N}_/+=-])[\p{L}\p{N}_/+-]++(?:[.=]++[\p{L}\p{N}_/+-]++)*+=*+"""
NAME = rf"(?<!\p{{L}})(?:{'|'.join(FEMALE_TITLES + MALE_TITLES)})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})"
PATTERN = "|".join([EMAIL, IP, PHONE, SSN, CARD, SECRET, NAME])
#: Texts without any of these hold no entity.
HINT = rf"[0-9@]|(?:{'|'.join(FEMALE_TITLES + MALE_TITLES)})\.? \p{{Lu}}|(?i:token|password|secret|api_key)\s{{0,2}}[=:]|AKIA[A-Z]{{16}}|[a-f]{{32}}|[A-F]{{32}}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used (inside lambdas, too)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mentions(text: Column) -> Column:
    """The entities in a text, in order; empty for a null text."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def taken_apart(text: Column) -> Column:
    """A text as an array: what stands between mentions at even places, the mentions at odd ones. Null for a null text."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    # a text that holds the mark itself is matched twice instead
    between, found = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    twice = F.flatten(F.zip_with(between, found, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    return F.when(~text.rlike(HINT), F.array(text)).when(text.contains(MARK), twice).otherwise(marked)


def kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[+(][\d(). -]+$|^\d{3}-\d{3}-\d{4}$"), "phone")
        .when(m.rlike(r"^[\d -]{13,19}$"), "card")
        .when(m.rlike(r"^[\p{L}-]+\.? \p{Lu}"), "name")
        .otherwise("secret")
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_hex(m: Column) -> Column:
    return m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")


def _gender(m: Column) -> Column:
    title = F.regexp_extract(m, r"^([\p{L}-]+)", 1)
    return F.when(title.isin(FEMALE_TITLES), "f").otherwise("m")


def units(m: Column) -> Column:
    """What a mention is replaced by parts: array of struct(type, norm). A name has a last name and perhaps a first, an address a domain."""
    return _let(kind(m), lambda k: _units(m, k))


def _units(m: Column, k: Column) -> Column:
    one = lambda type_, norm: F.struct(type_.alias("type"), norm.alias("norm"))
    words = F.split(F.regexp_replace(m, r"^[\p{L}-]+\.? ", ""), " ")
    last = lambda w: one(F.lit("last"), F.lower(F.element_at(w, -1)))
    first = lambda w: one(F.concat(F.lit("first_"), _gender(m)), F.lower(F.get(w, F.lit(0))))
    name = _let(words, lambda w: F.when(F.size(w) > 1, F.array(first(w), last(w))).otherwise(F.array(last(w))))
    address = F.array(one(k, F.lower(m)), one(F.lit("domain"), F.substring_index(F.lower(m), "@", -1)))
    national = lambda d: F.when((F.length(d) == 11) & m.startswith("+1"), F.substring(d, 2, 10)).when(m.startswith("+"), F.concat(F.lit("+"), d)).otherwise(d)
    number = _let(_digits(m), lambda d: F.when(k == "phone", national(d)).otherwise(d))
    secret = F.when(_is_hex(m), F.lower(m)).otherwise(m)
    norm = F.when(k.isin("phone", "card", "ssn"), number).when(k == "secret", secret).otherwise(m)
    return F.when(k == "name", name).when(k == "email", address).otherwise(F.array(one(k, norm)))


def _draw(seed: Column, i: Column, many: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(many))


def _letters(word: Column, seed: Column) -> Column:
    """A lower-case word letter for letter and digit for digit, within the script; other characters stay."""
    pick = lambda alphabet, i: F.substr(F.lit(alphabet), (_draw(seed, i, len(alphabet)) + 1).cast("int"), F.lit(1))
    return F.array_join(
        F.transform(
            F.split(word, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(CYRILLIC, i))
            .when(c.rlike(r"\p{IsGreek}"), pick(GREEK, i))
            .when(c.rlike(r"\p{L}"), pick(LATIN, i))
            .otherwise(c),
        ),
        "",
    )


def _number(digits: Column, seed: Column, low: Column) -> Column:
    """As many random digits; those at the places that ``low`` marks are 2 to 9."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(F.array_contains(low, i), _draw(seed, i, 8) + 2).otherwise(_draw(seed, i, 10)).cast("string")), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 where the check digit holds."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10


def _syllables(cyrillic: Column, seed: Column, attempt: Column, ending: Column) -> Column:
    """Three drawn syllables of the script, six from a later attempt on, and the ending."""
    places = F.when(attempt >= LONGER_FROM, F.sequence(F.lit(0), F.lit(5))).otherwise(F.sequence(F.lit(0), F.lit(2)))
    one = lambda own, k: F.element_at(F.split(F.lit(" ".join(own)), " "), (_draw(seed, k, len(own)) + 1).cast("int"))
    return F.concat(F.array_join(F.transform(places, lambda k: F.when(cyrillic, one(CYRILLIC_SYLLABLES, k)).otherwise(one(LATIN_SYLLABLES, k))), ""), ending)


def surrogate(type_: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The replacement of a normalised entity, normalised as well: a function of the key, the type, it and the attempt.

    That of an e-mail address has the new name before the old domain, which is an entity of its own.
    """
    return _let(F.sha2(F.concat_ws("|", F.lit(key), type_, norm, attempt.cast("string")), 256), lambda seed: _drawn(type_, norm, attempt, seed))


def _drawn(type_: Column, norm: Column, attempt: Column, seed: Column) -> Column:
    longer = F.when(attempt >= LONGER_FROM, F.substr(F.translate(seed, "0123456789", "ghijklmnop"), F.lit(1), F.lit(4))).otherwise("")
    email = F.concat(_letters(F.substring_index(norm, "@", 1), seed), longer, F.lit("@"), F.substring_index(norm, "@", -1))
    tail = F.when(norm.rlike(r"(^|\.)example\.(com|org|net)$"), F.substring_index(norm, ".", -2)).otherwise(F.substring_index(norm, ".", -1))
    domain = F.when(norm.isin(RESERVED), norm).otherwise(_let(tail, lambda t: F.concat(longer, _letters(F.substr(norm, F.lit(1), F.length(norm) - F.length(t)), seed), t)))
    intl = F.concat(F.lit("+"), F.substring(norm, 2, 1), _number(F.substr(norm, F.lit(3)), seed, F.array(F.lit(1))))
    phone = F.when(norm.startswith("+"), intl).otherwise(_number(norm, seed, F.array(F.lit(1), F.lit(4))))
    body = F.concat(F.substring(norm, 1, 1), _number(F.substr(norm, F.lit(2), F.length(norm) - 2), seed, F.array(F.lit(0))))
    good = lambda b: (10 - _luhn(F.concat(b, F.lit("0")))) % 10
    checked = lambda b: _let(good(b), lambda g: F.when(_luhn(norm) == 0, g).otherwise((g + 1 + _draw(seed, F.lit(99), 9)) % 10))
    card = _let(body, lambda b: F.concat(b, checked(b).cast("string")))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    hexes = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.lower(F.hex(_draw(seed, i, 16)))), "")
    letter = lambda i: F.substr(F.lit(LATIN), (_draw(seed, i, 26) + 1).cast("int"), F.lit(1))
    mixed = F.array_join(
        F.transform(
            F.split(norm, ""),
            lambda c, i: F.when((i < 4) & norm.startswith("AKIA"), c).when(c.rlike(r"\p{N}"), _draw(seed, i, 10).cast("string")).when(c.rlike("[A-Z]"), F.upper(letter(i))).when(c.rlike(r"\p{L}"), letter(i)).otherwise(c),
        ),
        "",
    )
    name = _let(norm.rlike(r"\p{IsCyrillic}"), lambda cyrillic: _syllables(cyrillic, seed, attempt, _ending(type_, cyrillic)))
    return (
        F.when(type_ == "email", email)
        .when(type_ == "domain", domain)
        .when(type_ == "phone", phone)
        .when(type_ == "card", card)
        .when(type_ == "ssn", _number(norm, seed, F.array(F.lit(1))))
        .when(type_ == "ip", ip)
        .when(type_ == "secret", F.when(norm.rlike("^[0-9a-f]+$"), hexes).otherwise(mixed))
        .otherwise(name)
    )


def _ending(type_: Column, cyrillic: Column) -> Column:
    either = lambda own, latin: F.when(cyrillic, own).otherwise(latin)
    return F.when(type_ == "first_f", either("а", "a")).when(type_ == "first_m", either("ор", "o")).otherwise(either("ин", "er"))


def _in_format(m: Column, digits: Column) -> Column:
    """A mention with its last digits replaced by ``digits``; what else stands in it stays."""
    return _let(F.struct(digits.alias("d"), (F.length(_digits(m)) - F.length(digits)).alias("spare")), lambda x: _filled(m, x["d"], x["spare"]))


def _filled(m: Column, digits: Column, spare: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    step = lambda a, c: F.when(
        c.rlike("[0-9]"),
        F.struct(F.concat(a["out"], F.when(a["n"] < spare, c).otherwise(F.substr(digits, a["n"] - spare + 1, F.lit(1)))).alias("out"), (a["n"] + 1).alias("n")),
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))
    return F.aggregate(F.split(m, ""), start, step, lambda a: a["out"])


def replacement(m: Column, attempts: Column, key: str) -> Column:
    """What stands for a mention; ``attempts``: map from ``type:norm`` to attempt numbers above 0."""
    tried = lambda u: F.coalesce(F.try_element_at(attempts, F.concat_ws(":", u["type"], u["norm"])), F.lit(0))
    made = lambda k: F.transform(_units(m, k), lambda u: surrogate(u["type"], u["norm"], tried(u), key))
    return _let(kind(m), lambda k: _let(made(k), lambda parts: _shown(m, k, parts)))


def _shown(m: Column, k: Column, parts: Column) -> Column:
    """The parts of a replacement in the form that the mention has."""
    one = F.get(parts, F.lit(0))
    address = F.concat(F.substring_index(one, "@", 1), F.lit("@"), F.get(parts, F.lit(1)))
    name = F.concat(F.regexp_extract(m, r"^([\p{L}-]+\.? )", 1), F.array_join(F.transform(parts, lambda p: F.initcap(p)), " "))
    shouted = lambda x: F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(x)).otherwise(x)
    return (
        F.when(k == "name", name)
        .when(k.isin("phone", "card", "ssn"), _in_format(m, F.regexp_replace(one, "[+]", "")))
        .when(k == "email", shouted(address))
        .when((k == "secret") & _is_hex(m), shouted(one))
        .otherwise(one)
    )


def attempts_of(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """Distinct (type, norm) -> those with an attempt number above 0, such that all replacements are distinct and none is real.

    Where ``MAX_ROUNDS`` drawings have not found a free one (a format of few digits whose numbers are all taken), the last is kept.
    """
    now = entities.withColumn("attempt", F.lit(0))
    for round_ in range(MAX_ROUNDS):
        drawn = now.withColumn("made", surrogate(F.col("type"), F.col("norm"), F.col("attempt"), key))
        order = Window.partitionBy("type", "made").orderBy("attempt", "norm")
        real = entities.select("type", F.col("norm").alias("made"), F.lit(True).alias("real"))
        tested = drawn.withColumn("turn", F.row_number().over(order)).join(real, ["type", "made"], "left")
        again = (F.coalesce("real", F.lit(False)) | (F.col("turn") > 1)) & ~((F.col("type") == "domain") & F.col("norm").isin(RESERVED))
        tested = scratch.keep(tested.select("type", "norm", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), f"attempts-{round_}")
        if round_:
            scratch.drop(f"attempts-{round_ - 1}")
        now = tested.drop("again")
        if not tested.filter("again").limit(1).count():
            break
    return now.filter("attempt > 0")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with surrogates in ``text_col`` and ``n_entities`` (int) added, replacing one that was there.

    ``key`` is the caller's secret: who knows it can find the few possible originals of a short number by trying all.
    Null texts stay null, with 0 entities; empty texts, other columns (of any name), null ids and repeated rows are kept as
    they are; an empty table gives no rows. Texts are read twice, for the entities and for the replacement, and cross the
    network only in the join beyond ``MAP_ENTRIES`` redrawn entities.
    """
    if not key:
        raise ValueError("surrogates need a key")
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col).cast("string")
    # explode_outer: a filter on the size of an array would be pushed below it and match the pattern once more
    found = docs.select(F.explode_outer(mentions(text)).alias("m")).filter("m IS NOT NULL")
    entities = scratch.keep(found.select(F.explode_outer(units(F.col("m"))).alias("u")).select("u.type", "u.norm").distinct(), "entities")
    redrawn = scratch.keep(attempts_of(entities, scratch, key), "redrawn").select(F.concat_ws(":", "type", "norm").alias("entity"), "attempt")
    columns = [c for c in docs.columns if c != "n_entities"]
    attempts, digest, parts = (fresh(columns, c) for c in ("_attempts", "_digest", "_parts"))
    rows = docs.select(*columns)
    if redrawn.limit(MAP_ENTRIES + 1).count() <= MAP_ENTRIES:
        whole = redrawn.agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("attempts"))
        rows = rows.withColumn(attempts, whole.scalar())
    else:
        rows = _with_attempts(rows, redrawn, scratch, text, attempts, digest)
    rows = rows.withColumn(parts, taken_apart(text))
    made = F.transform(parts, lambda p, i: F.when(i % 2 == 1, replacement(p, F.col(attempts), key)).otherwise(p))
    many = F.coalesce(F.floor(F.size(parts) / 2), F.lit(0)).cast("int")
    new = F.when(F.size(parts) < 2, text).otherwise(F.array_join(made, ""))
    return rows.select(*(new.alias(c) if c == text_col else F.col(c) for c in columns), F.greatest(many, F.lit(0)).alias("n_entities"))


def _with_attempts(rows: DataFrame, redrawn: DataFrame, scratch: Scratch, text: Column, attempts: str, digest: str) -> DataFrame:
    """``rows`` with the redrawn entities of their text as a map; a text that very many rows share is met by broadcast."""
    nothing = F.map_from_entries(F.array().cast("array<struct<entity: string, attempt: int>>"))
    own = rows.select(F.sha2(text, 256).alias("digest"), F.explode_outer(mentions(text)).alias("m")).filter("m IS NOT NULL")
    own = own.select("digest", F.explode_outer(units(F.col("m"))).alias("u")).groupBy("digest", F.concat_ws(":", "u.type", "u.norm").alias("entity")).count()
    own = _by_entity(own, redrawn)
    maps = scratch.keep(own.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("map"), F.max("count").alias("many")), "maps")
    large = F.col("many") > max(LARGE_ROWS, (maps.agg(F.sum("many")).first()[0] or 0) // LARGE_TEXTS)
    rows = rows.withColumn(digest, F.sha2(text, 256))
    hot, cold = (maps.filter(c).select(F.col("digest").alias(digest), F.col("map").alias(attempts)) for c in (large, ~large))
    met = rows.join(F.broadcast(hot), digest, "left_anti").join(cold, digest, "left").unionByName(rows.join(F.broadcast(hot), digest))
    return met.withColumn(attempts, F.coalesce(attempts, nothing)).drop(digest)


def _by_entity(own: DataFrame, redrawn: DataFrame) -> DataFrame:
    """(digest, entity, count) with the attempts of redrawn entities; those of very many texts are met by broadcast."""
    sizes = own.groupBy("entity").agg(F.count("*").alias("texts")).join(redrawn, "entity")
    total = sizes.agg(F.sum("texts")).first()[0] or 0
    large = F.col("texts") > max(LARGE_ROWS, total // LARGE_TEXTS)
    hot, cold = sizes.filter(large).drop("texts"), sizes.filter(~large).drop("texts")
    return own.join(F.broadcast(hot), "entity").unionByName(own.join(F.broadcast(hot), "entity", "left_anti").join(cold, "entity"))
