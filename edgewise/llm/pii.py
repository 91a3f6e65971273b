"""Surrogates for personal data, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The key that the registered queries use, so that their results can be compared. Whoever doesn't know the key can't tell which entity
#: a surrogate stands for, so replace_pii() has no default: pass a secret of your own, or set it in the session.
KEY = "edgewise"
KEY_SETTING = "spark.edgewise.pii.key"
#: Country calling codes of one and two digits; all others have three. Fixed values.
_CALLING = r"^\+?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Attempts after which the space that surrogates are drawn from grows with each attempt.
NARROW = 2

_MALE = "Mr|Mister|Herr|Monsieur|Señor|Господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Госпожа"
#: A capitalised word of a name, with hyphens and apostrophes inside it; a possessive 's is not part of it.
_PART = r"\p{Lu}(?:[\p{L}\p{M}]|[-‐‑](?=\p{L})|['’](?=\p{L})(?!s(?![\p{L}\p{M}])))+"
#: What is looked for, in this order where two begin at the same place. Java patterns.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<=password=)[^\s\"'&#]{6,}+|(?<=token = \")[0-9A-Za-z]{16,}|(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![0-9A-Za-z]|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![0-9A-Za-z])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![0-9A-Za-z-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_MALE}|{_FEMALE})\.? {_PART}(?: {_PART})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

_SYMBOLS = "*+-_.!$%/:;=?@^~"
_LOWER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: Syllables of made-up names, and the ends that mark a gender.
_SYLLABLES = "ba be bo da de do fa fe ga ka ko la le li lo lu ma me mi mo na ne no ra re ri ro sa se ta te va".split()
_SYLLABLES_CYRILLIC = "ба бе бо да де до га ка ко ла ле ли ло лу ма ме ми мо на не но ра ре ри ро са се та те ва ве зо".split()


def kind_of(entity: Column) -> Column:
    """The first pattern that the whole of it matches, without regard to what stood around it."""
    bare = {"secret": r"AKIA[0-9A-Z]{16}|[0-9a-f]{32,}", "phone": r"\+\d.*|\(\d{3}\).*|\d{3}-\d{3}-\d{4}", "ssn": r"\d{3}-\d{2}-\d{4}", "card": r"\d(?:[ -]?\d){12,18}", "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"}
    bare |= {"iban": r"[A-Z]{2}\d{2}[ A-Z0-9]+", "ip": r"\d+\.\d+\.\d+\.\d+", "name": rf"(?:{_MALE}|{_FEMALE})\.? .*"}
    cases = [F.when(entity.rlike(rf"\A(?:{bare[k]})\z"), F.lit(k)) for k in ("email", "iban", "ip", "phone", "ssn", "card", "name")]
    return F.coalesce(F.when(entity.rlike(rf"\A(?:{bare['secret']})\z"), F.lit("secret")), *cases, F.lit("secret"))


def normal(kind: Column, entity: Column) -> Column:
    """What mentions of the same entity have in common: digits of numbers (and the + of phones), the address in small letters. Names have parts."""
    return (
        F.when(kind == "phone", F.regexp_replace(entity, r"[^+\d]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(entity, r"\D", ""))
        .when(kind == "email", F.lower(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .otherwise(entity)
    )


def parts(kind: Column, entity: Column) -> Column:
    """(kind, norm) of what surrogates are drawn for: of a name its surname and, if it is there, its first name; else the entity itself."""
    rest = F.regexp_extract(entity, r"^\S+ (.*)$", 1)
    part = lambda k, x: F.struct(k.alias("kind"), x.alias("norm"))
    surname = F.array(part(F.lit("surname"), F.regexp_extract(rest, r"(\S+)$", 1)))
    first = F.array(part(F.lit("first"), F.regexp_extract(rest, r"^(\S+) ", 1)))
    return F.when(kind != "name", F.array(part(kind, normal(kind, entity)))).when(rest.contains(" "), F.concat(first, surname)).otherwise(surname)


def _pick(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), (byte % len(alphabet) + 1).cast("int"), F.lit(1))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often use asks for it."""
    return F.transform(F.array(value), use)[0]


def _luhn(digits: Column) -> Column:
    """The check digit for digits that lack it."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return ((10 - total % 10) % 10).cast("string")


def surrogate(kind: Column, entity: Column, norm: Column, attempt: Column, key: str = KEY) -> Column:
    """A replacement of the same kind, format and script, drawn from the keyed hash of (kind, norm, attempt).

    Mentions with the same norm get the same digits and letters, each in its own format. Numbers keep their separators,
    cards their first digit and a right check digit if they had one, phones their country code; addresses keep their top-level
    domain; letters stay in their case and script; symbols of secrets become other symbols. A part of a name is made up from
    that part alone; entity is the whole name, whose title tells the gender of the end (without a title: male).

    From attempt NARROW on the space grows with each attempt: names get more syllables, addresses and secrets more letters,
    phones more digits.
    """
    inner = F.sha2(F.concat(F.lit(f"{key}|"), kind, F.lit("|"), norm, F.lit("|"), attempt.cast("string")).cast("binary"), 512)
    return _let(F.sha2(F.concat(F.lit(f"{key}#"), inner).cast("binary"), 512), lambda stream: _drawn(kind, entity, norm, stream, F.greatest(attempt - (NARROW - 1), F.lit(0))))


def _drawn(kind: Column, entity: Column, norm: Column, stream: Column, extra: Column) -> Column:
    """The replacement that the hash in stream (hex) stands for, longer by extra letters, digits or syllables where its kind allows."""
    byte = lambda i: F.conv(F.substring(stream, ((i % 64) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    letter = lambda c, b: (
        F.when(c.rlike("[0-9]"), _pick(_DIGITS, b))
        .when(c.rlike(r"\p{IsCyrillic}"), F.when(c == F.upper(c), F.upper(_pick(_CYRILLIC, b))).otherwise(_pick(_CYRILLIC, b)))
        .when(c.rlike(r"\p{IsGreek}"), F.when(c == F.upper(c), F.upper(_pick(_GREEK, b))).otherwise(_pick(_GREEK, b)))
        .when(c.rlike(r"\p{L}"), F.when(c.rlike(r"\p{Lu}"), F.upper(_pick(_LOWER, b))).otherwise(_pick(_LOWER, b)))
        .otherwise(c)
    )

    symbol = lambda c, b: F.when(c.rlike(r"[0-9\p{L}]"), letter(c, b)).otherwise(_pick(_SYMBOLS, b))
    grown = lambda one: F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: one(byte(24 + i))), "")).otherwise("")

    def spelled(text: Column, one) -> Column:
        """text with one(character, its place, text) for each character."""
        return _let(text, lambda t: F.array_join(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: one(F.substring(t, i, F.lit(1)), i, t)), ""))

    def digits(text: Column, first: Column, drawn: Column) -> Column:
        """text with its digits from the first-th on taken from drawn."""
        nth = lambda t, i: F.length(F.regexp_replace(F.substring(t, F.lit(1), i), r"\D", ""))
        put = lambda d, after: spelled(text, lambda c, i, t: F.when(c.rlike(r"\d") & (nth(t, i) > after), F.substring(d, nth(t, i), F.lit(1))).otherwise(c))
        return _let(drawn, lambda d: _let(first, lambda after: put(d, after)))

    drawn = spelled(F.regexp_replace(norm, r"^\+", ""), lambda c, i, t: F.when(c.rlike("[0-9]"), _pick(_DIGITS, byte(i))).otherwise(c))
    code = F.regexp_extract(norm, _CALLING, 1)
    country = F.when(~norm.startswith("+"), 0).when(code == "", 3).otherwise(F.length(code))
    sound = _luhn(F.substring(norm, F.lit(1), F.length(norm) - 1)) == F.substring(norm, -1, 1)

    def card(d: Column) -> Column:
        body = F.concat(F.substring(norm, 1, 1), F.substring(d, F.lit(2), F.length(norm) - 2))
        return _let(body, lambda b: F.concat(b, F.when(sound, _luhn(b)).otherwise(F.substring(d, -1, 1))))

    octet = lambda i: (byte(F.lit(2 * i)) * 256 + byte(F.lit(2 * i + 1))) % 254 + 1
    ip = F.concat_ws(".", *[octet(i).cast("string") for i in range(4)])
    top = F.regexp_extract(entity, r"(\.\p{L}+)$", 1)
    email = F.concat(grown(lambda b: _pick(_LOWER, b)), spelled(F.substring(entity, F.lit(1), F.length(entity) - F.length(top)), lambda c, i, t: letter(c, byte(i))), top)
    head = F.regexp_extract(entity, "^(AKIA)?", 1)
    tail = F.substring(entity, F.length(head) + 1, F.length(entity))
    hidden = lambda hexed: spelled(tail, lambda c, i, t: F.when(hexed, _pick(_HEX, byte(i))).otherwise(symbol(c, byte(i))))
    secret = F.concat(head, _let(tail.rlike(r"\A[0-9a-f]+\z"), hidden), grown(lambda b: _pick(_HEX, b)))
    iban = F.concat(F.substring(entity, 1, 2), spelled(F.substring(entity, F.lit(3), F.length(entity)), lambda c, i, t: letter(c, byte(F.length(F.regexp_replace(F.substring(t, F.lit(1), i), " ", ""))))))
    male, cyrillic = ~entity.rlike(rf"^(?:{_FEMALE})\.? "), norm.rlike(r"\p{IsCyrillic}")
    syllable = lambda table, b: F.array(*map(F.lit, table))[b % len(table)]
    made = lambda table, at, n: F.initcap(F.concat(*[syllable(table, byte(F.lit(at + i))) for i in range(n)], grown(lambda b: syllable(table, b))))
    first = F.when(cyrillic, F.concat(made(_SYLLABLES_CYRILLIC, 0, 3), F.when(male, "н").otherwise("на"))).otherwise(F.concat(made(_SYLLABLES, 0, 3), F.when(male, "n").otherwise("na")))
    last = F.when(cyrillic, F.concat(made(_SYLLABLES_CYRILLIC, 8, 3), F.when(male, "в").otherwise("ва"))).otherwise(F.concat(made(_SYLLABLES, 8, 3), F.lit("r")))
    return (
        F.when(kind == "email", email).when(kind == "phone", F.concat(digits(entity, country, drawn), grown(lambda b: _pick(_DIGITS, b)))).when(kind == "card", digits(entity, F.lit(0), _let(drawn, card)))
        .when(kind == "ssn", digits(entity, F.lit(0), drawn)).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "first", first).when(kind == "surname", last).otherwise(secret)
    )


def attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt) for entities (kind, norm): with these attempts no two surrogates of a kind are alike, and none is an entity of the data.

    All start at 0. Of those whose surrogates collide the first by norm stays and the others draw again, as do those whose
    surrogate is itself an entity, until none is left. That ends: the space of names, addresses, secrets and phones grows
    with the attempts, and that of the other kinds is larger than the number of entities a table can hold (SSNs: 10^9).
    """
    now = cut(entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)), "entities")
    while True:
        kind, norm = F.col("kind"), F.col("norm")
        drawn = cut(now.withColumn("s", _let(surrogate(kind, norm, norm, F.col("attempt"), key), lambda s: normal(kind, s))), "surrogates")
        first = drawn.groupBy("kind", "s").agg(F.min("norm").alias("owner"), F.count("*").alias("n")).where("n > 1").select("kind", "s", "owner")
        taken = drawn.join(first, ["kind", "s"]).where("norm != owner").select("kind", "norm")
        # A made-up part of a name has one more letter behind a female title.
        known = now.select("kind", F.explode(F.when(kind.isin("first", "surname"), F.array(norm, F.regexp_replace(norm, "[aа]$", ""))).otherwise(F.array(norm))).alias("s"))
        real = drawn.join(known, ["kind", "s"], "left_semi").select("kind", "norm")
        again = cut(taken.unionByName(real).distinct(), "again")
        if again.isEmpty():
            return now
        now = now.join(again.withColumn("more", F.lit(1)), ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
        now = cut(now, "entities")


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text free of the entities that PATTERNS finds, and n_entities (mentions replaced; a column of that name is replaced).

    key: the secret that surrogates are drawn with; without it that of the session (KEY_SETTING); without either an error.
    The pattern is looked for once in each text, whose mentions are written beside it. Texts without any are passed on as
    they are, without a shuffle. Of the others the mentions are joined with the attempts of their entities and come back to
    their document as one map, whose surrogates are set between the pieces of the text. Where a text names someone with
    title, first name and surname, the same first name and surname without a title are replaced in it too. The same entity
    gets the same surrogate in all documents, and different entities different ones. Null texts stay null (n_entities 0).
    Rows stay as many; rows with the same id and text get the same text. An empty table gives an empty table.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"a key is needed: pass one or set {KEY_SETTING}")
    docs = docs.drop("n_entities")
    columns = docs.columns
    # Everything that is looked for holds a digit, an at sign, or a title; the cheap test keeps the long pattern from most texts.
    cheap = F.coalesce(F.col("text").rlike(rf"[0-9@]|password=|(?:{_MALE}|{_FEMALE})\.? "), F.lit(False))
    marked = cut(docs.withColumn("__names", F.when(cheap, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))), "marked")
    clean = marked.where(F.size("__names") == 0).select(*columns, F.lit(0).cast("long").alias("n_entities"))
    row = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    dirty = marked.where(F.size("__names") > 0).withColumn("__row", row)
    found = dirty.select(F.col("__row").alias("row"), F.explode(F.array_distinct("__names")).alias("entity"))
    found = found.withColumn("kind", kind_of(F.col("entity")))
    found = cut(found.select("row", "entity", F.posexplode(parts(F.col("kind"), F.col("entity"))).alias("at", "part")).select("row", "entity", "at", "part.*"), "mentions")
    tries = attempts(found, key)
    mapped = found.join(tries, ["kind", "norm"]).select("row", "entity", "at", "kind", surrogate(F.col("kind"), F.col("entity"), F.col("norm"), F.col("attempt"), key).alias("s"))
    title = F.when(F.first("kind").isin("first", "surname"), F.regexp_extract("entity", r"^(\S+ )", 1)).otherwise("")
    whole = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("at", "s"))), lambda x: x["s"]), " ")
    mapped = mapped.groupBy("row", "entity").agg(title.alias("title"), whole.alias("s"), (F.countDistinct("at") > 1).alias("full"))
    bare = F.struct(F.regexp_extract("entity", r"^\S+ (.*)$", 1).alias("k"), F.col("s").alias("v"))
    maps = mapped.groupBy("row").agg(
        F.map_from_entries(F.collect_set(F.struct("entity", F.concat("title", "s")))).alias("__map"),
        # One name with titles of both genders has two forms; the smaller one stands for the bare name.
        F.array_sort(F.collect_set(F.when(F.col("full"), bare))).alias("__bare"),
    )
    maps = maps.withColumn("__bare", F.map_from_entries(F.filter("__bare", lambda x, i: (i == 0) | (F.get("__bare", i - 1)["k"] != x["k"]))))
    dirty = dirty.join(maps.withColumnRenamed("row", "__row"), "__row")
    put = lambda gaps, names, by: F.array_join(F.zip_with(gaps, names, lambda g, e: F.concat(g, F.coalesce(by[e], F.lit("")))), "")
    dirty = dirty.withColumn("text", put(F.split("text", ANY, -1), F.col("__names"), F.col("__map")))
    quoted = F.transform(F.map_keys("__bare"), lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E")))
    again = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}]|[-‐‑'’]\p{L})"))
    some = F.size("__bare") > 0
    dirty = dirty.withColumn("__more", F.when(some, F.regexp_extract_all("text", again, F.lit(0))).otherwise(F.array().cast("array<string>")))
    dirty = dirty.withColumn("text", F.when(F.size("__more") > 0, put(F.split("text", again, -1), F.col("__more"), F.col("__bare"))).otherwise(F.col("text")))
    return clean.unionByName(dirty.select(*columns, (F.size("__names") + F.size("__more")).cast("long").alias("n_entities")))


def op2(spark, sf_dir: str) -> DataFrame:
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), KEY).select("doc_id", "n_entities", "text")
