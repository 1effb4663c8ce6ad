"""PII surrogates: detected entities become keyed stand-ins of the same type and format.

Plan.  One regular expression finds entities in a scan; only (document, place, entity) rows leave it.  Each distinct entity,
in its normal form, gets a surrogate from a keyed hash, so that every mention of it, in whatever format, gets the same one.
A person is two entities, given and family name, so "Mr. John Smith", "Mrs. Smith" and "Mr Smith" stay in keeping; the full
names that a document gives after a title are also found in it without one.  Surrogates are checked: two entities of a type
may not share one, and none may equal an entity that the corpus holds; those that fail are drawn again with the next
attempt number, from a larger space, until none fails.  Surrogates are then written into the format of each mention and
spliced between the pieces of text that the same expression leaves.  All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quandrel.llm.staging import staged

# Patterns of entities, titles and stand-in names.
TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señor|Sra|Г-жа|Г-н|Господин|Госпожа)"
NAME = r"\p{Lu}[\p{L}'-]+"
# Kinds that begin where a word may begin, and those that begin with a digit, a sign or a bracket.
AT_WORDS = {
    "email": r"(?<![A-Za-zÀ-ÖØ-öø-ɏ0-9._%+-])[A-Za-zÀ-ÖØ-öø-ɏ0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]|-(?!----))++-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "api_token": r"\b(?:(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+)",
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "secret": r"\b(?i:(?:[a-z0-9]{1,20}+[_-]){0,3}(?:password|passwd|passwort|pwd|token|secret|api[_-]?key)(?:[_-](?:access[_-])?key)?)[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?:[A-Za-z0-9+/_.=~-]{7,}[A-Za-z0-9+/_=~-]|(?=[A-Za-z]*[0-9])[A-Za-z0-9]{6,7}(?![A-Za-z0-9+/_=~-]))[\"']?",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[0-9]{4}){2} ?[0-9]{3})\b",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![0-9A-Za-z:])",
    "person": rf"\b{TITLE}\.? {NAME}(?: {NAME})?",
}
AT_NUMBERS = {
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "card": r"(?<![0-9+.-])(?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])|[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![0-9]))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
PATTERNS = AT_WORDS | AT_NUMBERS
FEMALE, MALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Г-жа|Госпожа)\b", r"^(?:Mr|Herr|Monsieur|Señor|Г-н|Господин)\b"
NAMES = {
    ("f", "latin"): "Alma Bianca Clara Daria Elena Flora Greta Helga Irma Julia".split(),
    ("m", "latin"): "Anton Bruno Carl Dario Emil Fabio Georg Hugo Ivo Jonas".split(),
    ("n", "latin"): "Alexis Charlie Dominique Eden Jules Kim Noa Robin Sam Toni".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Ирина Лидия Мария Нина".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Лев Максим Олег".split(),
    ("n", "cyrillic"): "Женя Саша Валя Слава Паша Шура Миша Тоня Вася Юля".split(),
}
SYLLABLES = {"latin": "ba be bo da den do fa fel ga gor ka lan len mar mon nel ran sol tan vor".split(), "cyrillic": "ба бе бо да ден до фа фел га гор ка лан лен мар мон нел ран сол тан вор".split()}
ENDINGS = {("f", "latin"): "a", ("m", "latin"): "o", ("n", "latin"): "i", ("f", "cyrillic"): "а", ("m", "cyrillic"): "ий", ("n", "cyrillic"): "е"}
# Most places in a text begin no word and no number: two cheap looks spare them the list of patterns.
ENTITY = r"(?<![A-Za-z0-9_])(?:" + "|".join(f"(?:{p})" for p in AT_WORDS.values()) + r")|(?=[0-9(+])(?:" + "|".join(f"(?:{p})" for p in AT_NUMBERS.values()) + ")"
FULL_NAME = rf"^{TITLE}\.? ({NAME} {NAME})$"
#: Names get a syllable more with each attempt; from this attempt on, octets of addresses are of any length and other
#: surrogates longer than their entities, by a character more with each attempt.
WIDER = 8


def kind_of(entity: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return F.coalesce(found, F.when(entity.rlike(f"^{NAME} {NAME}$"), "person"), F.lit("secret"))


def normal(kind: Column, entity: Column) -> Column:
    """What mentions of one entity share: digits of numbers, without a leading +1; lower case; the family name of a person."""
    digits = F.regexp_replace(F.regexp_replace(entity, r"^\+1(?=(?:[^0-9]*[0-9]){10}$)", ""), "[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" ")))
        .when(kind == "person", F.substring_index(entity, " ", -1))
        .otherwise(entity)
    )


def given_of(kind: Column, mention: Column) -> Column:
    """The given name of a person who is named in full, else null."""
    names = F.regexp_replace(mention, rf"^{TITLE}\.? ", "")
    return F.when((kind == "person") & F.contains(names, F.lit(" ")), F.substring_index(names, " ", 1))


def stream(key: str, *parts: Column) -> Column:
    """192 keyed hex digits."""
    first = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)
    return F.concat(first, F.sha2(F.concat(F.lit(key), first), 256), F.sha2(F.concat(first, F.lit(key)), 256))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, entity, gender, attempt) with ``surrogate``, of the entity's length but for names and late attempts."""
    from_hex = lambda h, i: F.conv(F.substring(h, F.pmod((i - 1) * 2, F.lit(192)) + 1, F.lit(2)), 16, 10).cast("int")
    rows = entities.withColumn("h", stream(key, F.col("kind"), F.col("entity"), F.col("attempt").cast("string")))
    rows = rows.withColumn("h_domain", stream(key, F.lit("domain"), F.substring_index("entity", "@", -1), F.col("attempt").cast("string")))
    e, n = F.col("entity"), F.length("entity")
    sign, at = F.regexp_instr(e, F.lit("[=:]")), F.instr(e, "@")
    top = n - F.length(F.substring_index(e, ".", -1))  # where the last label of a mail address begins
    fixed = (
        F.when(F.col("kind") == "secret", sign)
        .when(F.col("kind") == "aws_key", 4)
        .when(F.col("kind") == "api_token", F.when(F.startswith(e, F.lit("eyJ")), 3).otherwise(F.regexp_instr(e, F.lit("[_-]"))))
        .when(F.col("kind") == "private_key", F.length(F.regexp_extract(e, "^-----[^-]*-----", 0)))
        .when(F.col("kind") == "iban", 2)
        .when(F.col("kind").isin("card", "phone"), 1)
        .otherwise(0)
    )
    hexadecimal = (F.col("kind") == "ipv6") | (F.col("kind") == "secret") & F.substring(e, sign + 1, n).rlike("^[ \\t\"']*[0-9a-f]+[\"']?$")

    def letter(alphabet: str, d: Column, size=None) -> Column:
        return F.substring(F.lit(alphabet), F.pmod(d, F.lit(size or len(alphabet))) + 1, F.lit(1))

    def char(i: Column) -> Column:
        c = F.substring(e, i, F.lit(1))
        d = F.when((F.col("kind") == "email") & (i > at), from_hex(F.col("h_domain"), i - at)).otherwise(from_hex(F.col("h"), i))
        keep = (i <= fixed) | ((F.col("kind") == "email") & (i > top)) | ((F.col("kind") == "private_key") & (i > n - F.length(F.regexp_extract(e, "-----[^-]*-----$", 0))))
        new = F.when(c.rlike("[0-9]"), letter("0123456789", d)).when(c.rlike("[a-z]"), F.when(hexadecimal, letter("abcdef", d)).otherwise(letter("abcdefghijklmnopqrstuvwxyz", d))).when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", d))
        return F.when(keep, c).otherwise(F.coalesce(new, c))

    spelled = F.array_join(F.transform(F.sequence(F.lit(1), n), char), "")
    wide = lambda o, k: (1 + F.conv(F.substring(F.col("h"), 8 * k + 9, F.lit(8)), 16, 10).cast("long") % 254).cast("int")
    octet = lambda o, k: F.when(F.col("attempt") >= WIDER, wide(o, k)).when(F.length(o) == 1, 1 + from_hex(F.col("h"), k + 1) % 9).when(F.length(o) == 2, 10 + from_hex(F.col("h"), k + 1) % 90).otherwise(100 + from_hex(F.col("h"), k + 1) % 155)
    address = F.array_join(F.transform(F.split(e, r"\."), lambda o, k: octet(o, k).cast("string")), ".")

    def luhn(digits: Column, size: Column) -> Column:
        """Sum of Luhn's digits of a number that still lacks its check digit."""
        value = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 0, 2).otherwise(1)
        return F.aggregate(F.transform(F.sequence(F.lit(1), size), lambda i: F.when(value(i) > 9, value(i) - 9).otherwise(value(i))), F.lit(0), lambda s, x: s + x)

    check = lambda digits: ((10 - luhn(digits, n - 1) % 10) % 10).cast("string")
    body = F.substring(spelled, F.lit(1), n - 1)
    card = F.when(F.substring(e, n, F.lit(1)) == check(e), F.concat(body, check(body))).otherwise(spelled)

    script = F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    made = lambda parts, first, more: F.initcap(F.array_join(F.transform(F.sequence(F.lit(first), F.col("attempt") + more), lambda i: F.element_at(F.array(*map(F.lit, parts)), from_hex(F.col("h"), i) % len(parts) + 1)), ""))
    for (g, s), names in NAMES.items():
        listed = F.element_at(F.array(*map(F.lit, names)), from_hex(F.col("h"), F.lit(1)) % len(names) + 1)
        own = F.when(F.col("attempt") == 0, listed).otherwise(F.concat(made(SYLLABLES[s], 2, 3), F.lit(ENDINGS[g, s])))
        given = F.when((F.col("gender") == g) & (script == s), own).otherwise(given)
    for s, parts in SYLLABLES.items():
        family = F.when(script == s, made(parts, 2, 4)).otherwise(family)
    late = F.greatest(F.lit(0), F.least(F.lit(180), F.col("attempt") - WIDER + 1))
    more = F.array_join(F.transform(F.sequence(F.lit(1), late), lambda i: letter("0123456789", from_hex(F.col("h"), i + 7))), "")
    longer = F.when(late == 0, F.when(F.col("kind") == "card", card).otherwise(spelled)).when(F.col("kind") == "email", F.concat(F.lit("x"), more, spelled)).otherwise(F.concat(spelled, more))
    chosen = F.when(F.col("kind") == "ipv4", address).when(F.col("kind") == "family", family).when(F.col("kind") == "given", given).otherwise(longer)
    return rows.withColumn("surrogate", chosen).drop("h", "h_domain")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct ``entities`` (kind, entity, gender): no two share one, none is an entity.

    A round draws again for those that fail; the space grows with the attempt, so rounds end.
    """
    now = staged(surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        held = now.groupBy("kind", "surrogate").agg(F.count("*").alias("holders"), F.min("entity").alias("holder"))
        real = entities.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("is_real"))
        judged = now.join(held, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        fails = F.coalesce("is_real", F.lit(False)) | (F.col("entity") != F.col("holder"))
        marked = staged(judged.select("kind", "entity", "gender", "attempt", "surrogate", fails.alias("fails")), "marked")
        if marked.filter("fails").isEmpty():
            return marked.select("kind", "entity", "surrogate")
        again = surrogates(marked.filter("fails").select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt")), key)
        now = staged(marked.filter("not fails").select("kind", "entity", "gender", "attempt", "surrogate").unionByName(again), "surrogates")


def written(kind: Column, mention: Column, surrogate: Column, given: Column) -> Column:
    """A surrogate in the format of a mention: punctuation of numbers, a leading +1, case of mail addresses, a person's title."""
    places = F.sequence(F.lit(1), F.length(mention))
    c = lambda i: F.substring(mention, i, F.lit(1))
    letters = lambda x: F.length(F.regexp_replace(x, "[^0-9A-Za-z]", ""))
    lead = F.greatest(F.lit(0), letters(mention) - F.length(surrogate))
    used = lambda i: letters(F.substring(mention, F.lit(1), i)) - lead
    filled = F.array_join(F.transform(places, lambda i: F.when(c(i).rlike("[0-9A-Za-z]") & (used(i) > 0), F.substring(surrogate, used(i), F.lit(1))).otherwise(c(i))), "")
    filled = F.concat(filled, F.substring(surrogate, letters(mention) + 1, F.length(surrogate)))
    shift = F.length(surrogate) - F.length(mention)  # a late attempt puts more before a mail address
    cased = F.concat(F.substring(surrogate, F.lit(1), shift), F.array_join(F.transform(places, lambda i: F.when(c(i).rlike("[A-Z]"), F.upper(F.substring(surrogate, i + shift, F.lit(1)))).otherwise(F.substring(surrogate, i + shift, F.lit(1)))), ""))
    person = F.concat(F.regexp_extract(mention, rf"^{TITLE}\.? ", 0), F.coalesce(F.concat(given, F.lit(" ")), F.lit("")), surrogate)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "email", cased).when(kind == "person", person).otherwise(surrogate)


def replace_pii(docs: DataFrame, key: str = "change-me") -> DataFrame:
    """``docs`` with entities of ``text`` replaced, and n_entities and kinds (distinct, sorted) added.

    Mail addresses, AWS keys, API tokens, private keys, assigned secrets, IBANs, IPv4 and IPv6 addresses, card numbers, US
    social security numbers, phone numbers and persons are found; persons after a title, or named in full as they are after
    a title elsewhere in the document.  The same ``key`` gives the same surrogates for the same corpus.  Cards that pass
    Luhn's test keep passing, a given name's gender follows its titles (neutral where they differ), script the name.

    Null text stays null with no entities; text without entities is unchanged.  Rows that repeat a doc_id are handled each
    by its own text.  Null doc_ids are handled too.  n_entities and kinds are replaced; other columns pass through, whatever
    they are named.  Texts of any length are read whole.
    """
    columns = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("document"), "text", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    scanned = mine.select("id", "row", "text", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("first")).filter(F.size("first") > 0)
    full = F.array_distinct(F.transform(F.filter("first", lambda x: x.rlike(FULL_NAME)), lambda x: F.regexp_extract(x, FULL_NAME, 1)))
    bare = F.array_join(F.transform("full", lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|")
    own = F.when(F.size("full") > 0, F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), bare, F.lit(r")(?!\p{L})")))
    named = scanned.withColumn("full", full).withColumn("own", own)
    found = named.select("id", "row", "own", F.when(F.col("own").isNull(), F.col("first")).otherwise(F.regexp_extract_all("text", F.col("own"), F.lit(0))).alias("mentions"))
    rows = found.select("id", "row", "own", F.posexplode("mentions").alias("place", "mention")).withColumn("kind", kind_of(F.col("mention")))
    titled = F.when(F.col("mention").rlike(FEMALE), "f").when(F.col("mention").rlike(MALE), "m")
    mentions = staged(rows.withColumns({"entity": normal(F.col("kind"), F.col("mention")), "given": given_of(F.col("kind"), F.col("mention")), "titled": titled}), "mentions")
    plain = mentions.select(F.when(F.col("kind") == "person", "family").otherwise(F.col("kind")).alias("kind"), "entity", F.lit(None).cast("string").alias("titled"))
    both = plain.unionByName(mentions.filter("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("entity"), "titled"))
    gender = F.when(F.min("titled") == F.max("titled"), F.min("titled")).otherwise("n")
    table = assign(staged(both.groupBy("kind", "entity").agg(gender.alias("gender")), "entities"), key)
    first = table.select(F.col("kind").alias("of_kind"), F.col("entity").alias("of_entity"), "surrogate")
    names = table.filter("kind = 'given'").select(F.col("entity").alias("given"), F.col("surrogate").alias("new_given"))
    placed = mentions.join(first, (F.when(F.col("kind") == "person", "family").otherwise(F.col("kind")) == F.col("of_kind")) & (F.col("entity") == F.col("of_entity"))).join(names, "given", "left")
    new = written(F.col("kind"), F.col("mention"), F.col("surrogate"), F.col("new_given"))
    lists = placed.select("id", "row", "own", "kind", F.struct("place", new.alias("new")).alias("at")).groupBy("id", "row").agg(F.first("own").alias("own"), F.array_sort(F.collect_set("at")).alias("news"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    lists = lists.select(F.col("id").alias("of_id"), F.col("row").alias("of_row"), "own", F.transform("news", lambda x: x["new"]).alias("news"), "kinds")
    joined = mine.join(lists.hint("shuffle_hash"), (F.col("id") == F.col("of_id")) & (F.col("row") == F.col("of_row")), "left")
    pieces = F.when(F.col("own").isNull(), F.split("text", ENTITY, -1)).otherwise(F.split("text", F.col("own"), -1))
    spliced = F.array_join(F.zip_with(pieces, F.concat("news", F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    text = F.when(F.col("news").isNull(), F.col("text")).otherwise(spliced)
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(f"document.`{c}`") for c in columns),
        F.coalesce(F.size("news"), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
    )


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, key="quandrel").select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
