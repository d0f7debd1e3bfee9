"""Personal data replaced by keyed surrogates, in DataFrame operations only.

Entities are found by one regular expression; a text is split at them and put
together again around their surrogates.  A surrogate is derived from a secret
key and the entity's canonical form, so one entity has one surrogate in the
whole corpus (coreference), and is written in the shape of the mention: digits
stay digits in the same grouping, case patterns and scripts stay, names keep
their grammatical gender, card numbers their check digit.  Surrogates of all
distinct entities are compared; where two entities of a type would share one,
or a surrogate is itself an entity of the corpus, all but the first are derived
again with a higher attempt number until all are distinct.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut

# Patterns of the entity types, tried in this order.
# Repetitions without a bound are possessive (++, *+), so long mentions need no stack, and each word is tried once.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)\s{0,9}+[=:]\s{0,9}+"
SECRET = rf"AKIA[0-9A-Z]{{16}}|(?<![0-9A-Za-z]){KEYWORD}\"?[0-9A-Za-z_\-+/~]{{8,}}+(?:[.=]++[0-9A-Za-z_\-+/~]++)*+\"?"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![\d.-])(?:[3-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)"
IPV6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\p{L}\p{N}:])"
PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
    # National forms: three groups with one separator, a leading zero and a long group, and the exit code.
    r"|(?<![\d.,/-])(?<!\d )\d{3}([ .])\d{3}\g1\d{4}(?![ .,/-]?\d)|(?<![\d.,/-])(?<!\d )0[1-9]\d{1,3}[ /-]\d{5,8}(?![ .,/-]?\d)|(?<![\d.,/-])(?<!\d )00[1-9]\d[ ./-]?\d{2,4}[ ./-]?\d{4,8}(?![ .,/-]?\d)"
).replace(r"([ .])\d{3}\g1", r"(?:(?= ) \d{3} |\.\d{3}\.)")
# Honorifics by gender, titles of both, and those written in capitals.
HE = r"Mr\.?|Sir|Herrn?|Monsieur|Señor|Sr\.|Signor|г-н|господин"
SHE = r"Mrs\.?|Ms\.?|Miss|Madam|Frau|Madame|Mme\.?|Señora|Sra\.|Signora|г-жа|госпожа"
ANY = r"Dr\.?|Prof\.?|Doctor|Professor|Doktor|Docteur"
CAPITAL_HE, CAPITAL_SHE = r"MR\.?|HERR|SEÑOR|MONSIEUR|DR\.|PROF\.", r"MRS\.?|MS\.|MISS|FRAU|MADAME|SEÑORA"
# What "Sr." stands before when it means senior.
POSTS = "Engineer|Developer|Manager|Analyst|Architect|Consultant|Director|Designer|Scientist|Administrator|Specialist|Programmer|Researcher|Accountant|Associate|Advisor|Officer|Technician|Recruiter|Editor|Writer|Nurse|Lead|Software|Data|Project|Product|Program|Systems|Staff|Sales|Marketing|Security|Network|Business|Full|Backend|Frontend|DevOps|QA"
# Particles of family names.
PARTS = "von|van|vom|der|den|de|del|della|di|da|dos|du|la|le|los|las|zu|zur|zum|af|av|ter|ten|bin|ibn|al|el"
# What stands before a name that someone gives.
CUES = "my name is|mein Name ist|ich heiße|je m'appelle|je m’appelle|mon nom est|me llamo|mi nombre es|меня зовут"
_CUES = CUES.replace(" ", r"\h{1,3}")
_S = r"\h{1,3}+"
#: A word of a name: a capital first; capitals, apostrophes and hyphens within, but no possessive s.
_WORD = r"\p{Lu}(?:['’]\p{L})?[\p{L}\p{M}]++(?:['’-](?!s(?![\p{L}]))[\p{L}\p{M}]++)*+"
_MIXED = rf"(?=[\p{{L}}\p{{M}}'’-]*\p{{Ll}}){_WORD}"
_CAPITALS = rf"(?![\p{{L}}\p{{M}}'’-]*\p{{Ll}}){_WORD}"
_LEAD = rf"(?:(?:{PARTS}){_S}){{0,3}}+"
_WORDS = rf"(?:{_LEAD}{_MIXED}(?:{_S}(?:\p{{Lu}}\.{_S})?{_LEAD}{_MIXED}){{0,2}}+|{_CAPITALS}(?:{_S}(?:\p{{Lu}}\.{_S})?{_CAPITALS}){{0,2}}+)"
_TITLE = rf"(?:(?:{HE}|{SHE}|{ANY})(?:{_S}(?:{ANY}))*+|{CAPITAL_HE}|{CAPITAL_SHE}){_S}"
_SENIOR = rf"(?!Sr\.(?:{_S}\p{{Lu}}\p{{L}}*+){{0,2}}{_S}(?:{POSTS})(?![\p{{L}}]))"
# What stands before is looked at behind a capital letter only.
NAME = rf"(?<![\p{{L}}]){_SENIOR}{_TITLE}{_WORDS}|(?=\p{{Lu}})(?<=(?iu:{_CUES})\h{{1,3}}){_WORDS}"
PATTERN = f"(?:{EMAIL}|{SECRET}|{IBAN}|{CARD}|{SSN}|{IP}|{IPV6}|{PHONE}|{NAME})"
# Given names by gender and script.
GIVEN = {
    ("he", "latin"): "Adam Bruno Carl David Emil Frank Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    ("she", "latin"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sarah Tina Vera".split(),
    ("he", "cyrillic"): "Антон Борис Виктор Глеб Денис Иван Кирилл Максим Олег Павел".split(),
    ("she", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Юлия".split(),
}
# Syllables of family names by script.
SYLLABLES = {"latin": "bar den fal gor hel kam lin mor nel par ros sel tor vel win zan".split(), "cyrillic": "бар вел гор дан зим кал лин мор нов пав рос сам тор фед хар яр".split()}
#: What every entity has some of; texts without it are not searched further.
HINT = r"(?iu)[0-9@=:]|AKIA|name\h{1,3}is|Name\h{1,3}ist|hei\u00dfe|appelle|nom\h{1,3}est|llamo|nombre\h{1,3}es|\u0437\u043e\u0432\u0443\u0442|(?-i:M(?:r|s|is|adam|me|onsieur|rs|R|S|I|ADAM|ONSIEUR)|S(?:ir|r|ra|e\u00f1or|ignor|IR|E\u00d1OR)|H(?:err|ERR)|F(?:rau|RAU)|D(?:r|R|oct|okt)|P(?:rof|ROF)|\u0433-|\u0433\u043e\u0441\u043f\u043e)"
#: Attempts after which a type that makes no progress has no free surrogates.
MAX_ATTEMPTS = 30


def _lit(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def entity_type(m: Column) -> Column:
    """Type of a mention, by the pattern that matches it whole."""
    out = F.lit("phone")
    for name, pattern in reversed((("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("card", CARD), ("ssn", SSN), ("ip", IP), ("ip", IPV6), ("phone", PHONE), ("name", NAME))):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    # A name behind a cue is all letters: its cue is not part of the mention.
    return F.when(m.rlike(f"^(?:{_WORDS})$"), F.lit("name")).otherwise(out)


def bare_name(m: Column) -> Column:
    """A person's name without title, in one spacing and in mixed case."""
    bare = F.regexp_replace(F.regexp_replace(m, rf"^{_TITLE}", ""), r"\h+", " ")
    return F.when(bare == F.upper(bare), F.initcap(F.lower(bare))).otherwise(bare)


def is_she(m: Column) -> Column:
    """Whether a mention of a person is female by its title, or else by a given name that is known."""
    known = "|".join(GIVEN["she", "latin"] + GIVEN["she", "cyrillic"])
    neutral = F.regexp_replace(m, rf"^(?:{ANY}|DR\.?|PROF\.?)(?:{_S}(?:{ANY}))*+{_S}", "")
    return m.rlike(rf"^(?:{SHE}|{CAPITAL_SHE}){_S}") | neutral.rlike(rf"^(?:{known})(?![\p{{L}}])")


def canonical(kind: Column, m: Column, she: Column) -> Column:
    """What two mentions of one entity have in common."""
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "email", F.lower(m))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "secret", F.regexp_replace(m, rf"^{KEYWORD}|\"", ""))
        .when(kind == "name", F.concat(F.when(she, "she").otherwise("he"), F.lit(":"), bare_name(m)))
        .when(kind == "ip", F.lower(m))
        .otherwise(m)
    )


def _digest(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that depend on the key."""
    seed = F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _byte(h: Column, k: int) -> Column:
    return F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")


def _pick(words: list[str], h: Column, k: int) -> Column:
    return F.element_at(_lit(words), (_byte(h, k) * 256 + _byte(h, k + 1)) % len(words) + 1)


def _refill(shape: Column, h: Column, keep: int | Column = 0) -> Column:
    """``shape`` with letters and digits drawn from ``h``, the first ``keep`` characters as they are; case and all else stay."""
    chars = F.split(shape, "")

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(h, (i * 2) % 127 + 1, 2), 16, 10).cast("int")
        letter = F.chr(F.lit(97) + v % 26)
        return (
            F.when(i < keep, c)
            .when(c.rlike(r"^\d$"), (v % 10).cast("string"))
            .when(c.rlike(r"^[\p{Lu}]$"), F.upper(letter))
            .when(c.rlike(r"^[\p{L}]$"), letter)
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """The digits with their last one replaced by the Luhn check digit."""
    n = F.length(digits)
    body = F.substring(digits, F.lit(1), n - 1)
    total = F.aggregate(
        F.transform(F.split(body, ""), lambda c, i: F.when((n - 2 - i) % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, b: a + b,
    )
    return F.concat(body, ((F.lit(10) - total % 10) % 10).cast("string"))


def surrogate(kind: Column, entity: Column, attempt: Column, h: Column) -> Column:
    """Canonical surrogate of a canonical entity, drawn from its digest ``h``."""
    local = F.substring_index(entity, "@", 1)
    hexes = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), F.substring(h, i % 127 + 1, F.lit(1))).otherwise(c)), "")
    ip = F.concat_ws(".", (_byte(h, 0) % 14 + 241).cast("string"), *[_byte(h, k).cast("string") for k in (1, 2)], (_byte(h, 3) % 254 + 1).cast("string"))
    cyr = entity.rlike(r"\p{IsCyrillic}")
    she = F.startswith(entity, F.lit("she:"))
    given = reduce(
        lambda rest, k: F.when((F.when(she, "she").otherwise("he") == k[0]) & (F.when(cyr, "cyrillic").otherwise("latin") == k[1]), _pick(GIVEN[k], h, 0)).otherwise(rest),
        GIVEN, F.lit("Alex"),
    )
    family = F.initcap(F.when(cyr, F.concat(*[_pick(SYLLABLES["cyrillic"], h, k) for k in (2, 4, 6)])).otherwise(F.concat(*[_pick(SYLLABLES["latin"], h, k) for k in (2, 4, 6)])))
    # Names grow with the attempts, so that any number of people has names of its own.
    more = F.aggregate(
        F.sequence(F.lit(1), attempt), F.lit(""),
        lambda done, i: F.concat(done, *[F.when(cyr, _pick(SYLLABLES["cyrillic"], F.sha2(F.concat(h, i.cast("string")), 256), k)).otherwise(_pick(SYLLABLES["latin"], F.sha2(F.concat(h, i.cast("string")), 256), k)) for k in (0, 2)]),
    )
    family = F.when(attempt > 0, F.concat(family, more)).otherwise(family)
    words = F.size(F.split(F.regexp_replace(F.substring_index(entity, ":", -1), rf"(?<![\p{{L}}])(?:{PARTS}) ", ""), " "))
    return (
        F.when(kind == "email", F.concat(_refill(local, h), F.lit("@"), F.substring(F.sha2(h, 256), 1, 10), F.lit(".example.net")))
        .when(kind == "ip", F.when(F.contains(entity, F.lit(":")), hexes).otherwise(ip))
        .when(kind == "card", _luhn(_refill(entity, h, 1)))
        .when(kind == "name", F.when(words == 1, family).otherwise(F.concat_ws(" ", given, family)))
        .when(kind == "iban", _refill(entity, h, 2))
        .when(kind == "secret", F.when(entity.startswith("AKIA"), _refill(entity, h, 4)).when(entity.rlike("^[0-9a-f]+$"), F.substring(F.repeat(h, 2), F.lit(1), F.length(entity))).when(entity.rlike("^[0-9A-F]+$"), F.upper(F.substring(F.repeat(h, 2), F.lit(1), F.length(entity)))).otherwise(_refill(entity, h)))
        .otherwise(_refill(entity, h, F.when(kind == "phone", F.greatest(F.lit(0), F.length(entity) - 10)).otherwise(0)))
    )


def in_shape(kind: Column, mention: Column, value: Column) -> Column:
    """The canonical surrogate written as the mention is."""
    chars = F.split(mention, "")
    digits_before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"\D", ""))
    grouped = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(value, digits_before(i) + 1, F.lit(1))).otherwise(c)), "")
    spaces_before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), " ", ""))
    iban = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(value, spaces_before(i) + 1, F.lit(1)))), "")
    title = F.regexp_extract(mention, f"^{_TITLE}", 0)
    bare = F.regexp_replace(mention, f"^{_TITLE}", "")
    lead = F.regexp_extract(mention, rf"^{KEYWORD}\"?", 0)
    return (
        F.when(kind.isin("phone", "card", "ssn"), grouped)
        .when(kind == "email", F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(value)).otherwise(value))
        .when(kind == "iban", iban)
        .when(kind == "name", F.concat(title, F.when(bare == F.upper(bare), F.upper(value)).otherwise(value)))
        .when(kind == "ip", F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(value)).otherwise(value))
        .when(kind == "secret", F.concat(lead, value, F.when(F.endswith(mention, F.lit('"')), F.lit('"')).otherwise(F.lit(""))))
        .otherwise(value)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (``kind``, ``entity``) rows with a ``surrogate`` each that no other row and no entity of the kind has."""
    todo = entities.select("kind", "entity", F.lit(0).alias("attempt"))
    done: list[DataFrame] = []
    left = None
    for attempt in count():
        # The digest is written first: a long entity's surrogate asks for it at every character.
        keyed = cut(todo.withColumn("h", _digest(key, F.col("kind"), F.col("entity"), F.col("attempt"))))
        tried = cut(keyed.select("kind", "entity", "attempt", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), F.col("h")).alias("surrogate")))
        best = tried.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        taken = entities.select("kind", F.col("entity").alias("surrogate"))
        for d in done:
            taken = taken.unionByName(d.select("kind", "surrogate"))
        good = cut(tried.join(best.hint("merge"), ["kind", "surrogate", "entity"], "left_semi").join(taken.hint("merge"), ["kind", "surrogate"], "left_anti").select("kind", "entity", "surrogate", F.lit(attempt).alias("attempt")))
        done.append(good)
        todo = cut(tried.join(good.hint("merge"), ["kind", "entity"], "left_anti").select("kind", "entity", F.lit(attempt + 1).alias("attempt")))
        before, left = left, todo.count()
        if not left:
            return reduce(DataFrame.unionByName, done)
        if attempt >= MAX_ATTEMPTS and left == before:
            raise ValueError(f"no distinct surrogates after {attempt + 1} attempts: a type's format has too few values")


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text``, ``n_entities``.

    Null text stays null, with 0 entities; empty texts stay empty.  Repeated
    rows and identifiers are treated each on its own, with equal surrogates.
    Other columns are not returned, whatever their names.  An empty table gives
    an empty result.  Texts are searched whole, and mentions may be of any
    length.  Texts without entities are passed through in place; only texts
    with entities are shuffled, in pieces between entities.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    rows = rows.withColumn("mentions", F.when(F.col("text").rlike(HINT), found).otherwise(F.array().cast("array<string>")))
    has = F.coalesce(F.size("mentions"), F.lit(0)) > 0
    plain = rows.filter(~has).select("doc_id", "text", F.lit(0).alias("n_entities"))
    hit = rows.filter(has).select("doc_id", "text", F.monotonically_increasing_id().alias("row"), "mentions")
    # People of two words and more are looked for once more, where the text has them without a title or cue.
    named = F.filter("mentions", lambda m: m.rlike(r"\h") & m.rlike(f"^(?:{_TITLE})?{_WORDS}$"))
    people = F.filter(F.transform(named, lambda m: F.struct(bare_name(m).alias("name"), is_she(m).alias("she"))), lambda p: F.contains(p["name"], F.lit(" ")))
    hit = hit.withColumn("people", people)
    again = F.size("people") > 0
    alternatives = F.array_join(F.array_distinct(F.transform("people", lambda p: F.regexp_replace(F.replace(p["name"], F.lit("."), F.lit("[.]")), " ", r"\\h{1,3}+"))), "|")
    wide = F.concat(F.lit(PATTERN[:-1] + r"|(?<![\p{L}\p{N}])(?:"), alternatives, F.lit(r")(?![\p{L}\p{N}]))"))
    hit = hit.withColumn("mentions", F.when(again, F.regexp_extract_all("text", wide, F.lit(0))).otherwise(F.col("mentions")))
    women = F.transform(F.filter("people", lambda p: p["she"]), lambda p: p["name"])
    # Texts are cut into one row per piece; a document's pieces meet again under its row number.
    gaps = F.when(again, F.split("text", wide, -1)).otherwise(F.split("text", PATTERN, -1))
    pieces = F.arrays_zip(gaps.alias("gap"), F.col("mentions").alias("mention"), F.transform("mentions", lambda m: F.array_contains(women, bare_name(m))).alias("she"))
    hit = cut(hit.select("doc_id", "row", F.posexplode(pieces).alias("pos", "p")).select("doc_id", "row", "pos", F.col("p.gap").alias("gap"), F.col("p.mention").alias("mention"), F.col("p.she").alias("she")))
    kind = entity_type(F.col("mention"))
    # The last piece of a text has no entity behind it and takes no part in the join.
    ends = hit.filter(F.col("mention").isNull()).select("doc_id", "row", "pos", F.coalesce("gap", F.lit("")).alias("piece"), F.lit(0).alias("one"))
    found = hit.filter(F.col("mention").isNotNull()).withColumn("kind", kind).withColumn("entity", canonical(F.col("kind"), F.col("mention"), is_she(F.col("mention")) | F.coalesce("she", F.lit(False))))
    names = assign(cut(found.select("kind", "entity").distinct()), key).select("kind", "entity", "surrogate")
    joined = found.join(names.hint("merge"), ["kind", "entity"])
    piece = F.concat(F.coalesce("gap", F.lit("")), in_shape(F.col("kind"), F.col("mention"), F.col("surrogate")))
    back = joined.select("doc_id", "row", "pos", piece.alias("piece"), F.lit(1).alias("one")).unionByName(ends).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda s: s["piece"]), "").alias("text"),
        F.sum("one").cast("int").alias("n_entities"),
    )
    return plain.unionByName(back.select("doc_id", "text", "n_entities"))
