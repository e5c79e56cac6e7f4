"""Personal data replaced by surrogates (DataFrame functions only).

Entities are e-mail addresses, telephone numbers, payment cards (13 to 19 digits with a valid check digit), network
addresses, social security numbers and persons named after a title. The key is the caller's secret: whoever has it can tell which surrogate an entity has. Each has a canonical form: spelling
variants of one entity share it, so they share the surrogate (coreference); where a document names a person with a title, the
full name counts without the title too. A surrogate is drawn from a keyed hash of type and canonical form,
so it is the same in every document and run, and keeps the type and the format: digits stay digits and separators stay where they
are, a card keeps a valid check digit and its first digit, a telephone number its country code, letters their case. A person gets a given name of the
gender that the title tells and a family name, both in the script of the original.

Distinctness is checked over the whole table: no two entities share a surrogate and no surrogate is an entity of the table. Those
that fail are drawn again with the next attempt number, MAX_ATTEMPTS times. Entities of a form so short that it has no free surrogate left then get
a surrogate that is longer than the form: 32 more keyed digits or letters set them apart, in place of the format.

Texts are cut by one pattern into entities and what lies between, so replacing never touches anything else. Rows without an entity pass
unchanged and are not shuffled.

Defined cases: null stays null and empty stays empty; texts are read whole; rows that repeat are changed alike; an empty table gives
an empty result; other columns are kept as they are (names that start with `_tl_` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: The setting in which a session may name its secret.
KEY_CONF = "spark.tideline.surrogate.key"
MAX_ATTEMPTS = 12

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
PHONE = r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])|(?<![A-Za-z0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])|(?<![A-Za-z0-9+.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z.-])"
IP = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])"
MALE = r"Mr|Herr|Señor|Monsieur|Господин|Κύριος"
FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Госпожа|Κυρία"
NEUTRAL = r"Dr|Prof|Доктор|Профессор|Δρ"
TITLES = rf"{FEMALE}|{MALE}|{NEUTRAL}"
#: Calling codes of one and two digits; all others have three.
CALLING_CODE = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3}"
PERSON = rf"(?<![\p{{L}}])(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?![\p{{L}}])"
ANY = "|".join([EMAIL, PHONE, IP, SSN, CARD, PERSON])
#: Every entity has one of these; most texts have none and skip the long pattern.
HINT = rf"@|[0-9][0-9 .()-]{{5,}}[0-9]|\+[0-9]|(?:{TITLES})\.? \p{{Lu}}"

GIVEN = {
    ("m", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul Ralf Simon Theo Viktor",
    ("f", "latin"): "Alma Berta Clara Diana Elena Flora Greta Hanna Irma Julia Klara Lena Maria Nora Olga Paula Rosa Sofia Tessa Vera",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег",
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Ирина Лидия Мария Ольга Юлия",
    ("m", "greek"): "Άρης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Παύλος Στέφανος Φίλιππος",
    ("f", "greek"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi wa",
    "cyrillic": "ба бо ва ве ви га го да де ди за ка ке ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си та те ти то",
    "greek": "βα βε γα γο δα δε ζα κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι τα τε τι το",
}
_DIGIT = "[0-9]"


def _hash(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def _pick(words: str, hexes: Column, at: int) -> Column:
    """One of the words by 7 hex digits of a hash."""
    own = words.split()
    return F.element_at(F.array(*map(F.lit, own)), (F.conv(F.substring(hexes, at, 7), 16, 10).cast("long") % len(own) + 1).cast("int"))


def _digits(key: str, n: Column, *seed: Column | str) -> Column:
    """n keyed digits."""
    block = lambda k: F.substring(F.translate(_hash(key, *seed, k.cast("string")), "abcdef", "024681"), 1, 48)
    return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 48).cast("int")), block), ""), F.lit(1), n)


def luhn_sum(digits: Column) -> Column:
    """The check sum of a card number; 0 modulo 10 is valid."""
    each = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.filter(F.transform(each, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"] != ""),
        F.lit(0),
        lambda acc, x: acc
        + F.when(x["i"] % 2 == 0, x["c"].cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), x["c"].cast("int") + 1)),
    )


def _kind(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@"), "email")
        .when(whole(PERSON), "person")
        .when(whole(IP), "ip")
        .when(whole(SSN), "ssn")
        .when(whole(PHONE), "phone")
        .when(whole(CARD) & F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0), "card")
    )


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(value: Column) -> Column:
    return F.when(value.rlike(rf"^(?:{FEMALE})\.? "), "f").when(value.rlike(rf"^(?:{MALE})\.? "), "m").otherwise("n")


def _name(value: Column) -> Column:
    return F.regexp_replace(value, rf"^(?:{TITLES})\.? ", "")


def _canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "person", F.concat_ws("|", _gender(value), _script(value), _name(value)))
        .when(kind == "ip", value)
        .when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits))
        .otherwise(digits)
    )


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A surrogate in canonical form."""
    a = attempt.cast("string")
    n = F.length(canon)
    h = _hash(key, kind, canon, a)
    # an address: a local part of the same length and pattern, and a reserved domain
    local, host = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    letters = F.translate(_hash(key, "local", canon, a), "0123456789", "ghijklmnop")
    filled = lambda text, tag: F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c, i: F.when(c.rlike("[a-z]"), F.substring(letters, i % 64 + 1, F.lit(1)))
            .when(c.rlike(_DIGIT), F.substring(_digits(key, F.lit(48), tag, canon, a), i % 48 + 1, F.lit(1)))
            .otherwise(c),
        ),
        "",
    )
    reserved = host.rlike(r"(?:^|\.)example\.(?:com|org|net)$")
    other_host = F.concat(F.lit("mail"), _digits(key, F.lit(10), "host", host), F.lit(".example.net"))
    email = F.concat(filled(local, "local"), F.lit("@"), F.when(reserved, _filled_host(key, host, canon, a)).otherwise(other_host))
    octet = lambda k: (F.conv(F.substring(h, k, 6), 16, 10).cast("long") % 254 + 1).cast("string")
    ip = F.concat_ws(".", octet(1), octet(7), octet(13), octet(19))
    body = _digits(key, n, kind, canon, a)
    lead = F.substring(canon, 1, 1)
    card = F.concat(lead, F.substring(body, F.lit(2), n - 2))
    check = (10 - luhn_sum(F.concat(card, F.lit("0"))) % 10) % 10
    parts = F.split(canon, r"\|")
    gender, script, name = parts[0], parts[1], parts[2]
    given, family = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    first, last = F.lit(None).cast("string"), F.lit(None).cast("string")
    hf = _hash(key, "family", family, a)
    for s, syllables in SYLLABLES.items():
        made = F.initcap(F.concat(*[_pick(syllables, hf, 1 + 7 * k) for k in range(4)]))
        last = F.when(script == s, made).otherwise(last)
        hg = _hash(key, "given", given, gender)
        own = F.when(gender == "n", F.when(F.substring(hg, 60, 1) < "8", "m").otherwise("f")).otherwise(gender)
        for g in "mf":
            first = F.when((script == s) & (own == g), _pick(GIVEN[g, s], hg, 1)).otherwise(first)
    person = F.concat_ws("|", gender, script, F.when(name.contains(" "), F.concat_ws(" ", first, last)).otherwise(last))
    code = F.regexp_extract(canon, rf"^\+(?:{CALLING_CODE})", 0)
    phone = F.when(code != "", F.concat(code, _digits(key, n - F.length(code), kind, canon, a))).otherwise(F.concat(lead, F.substring(body, F.lit(2), n - 1)))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", F.concat(card, check.cast("string")))
        .when(kind == "person", person)
        .when(kind == "phone", phone)
        .otherwise(body)
    )


def _filled_host(key: str, host: Column, canon: Column, attempt: Column) -> Column:
    """A reserved domain with its digits drawn anew."""
    own = _digits(key, F.lit(48), "host", canon, attempt)
    return F.array_join(
        F.transform(F.split(host, ""), lambda c, i: F.when(c.rlike(_DIGIT), F.substring(own, i % 48 + 1, F.lit(1))).otherwise(c)), ""
    )


def _render(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of the value it replaces; digits for which the value has no place follow at the end."""
    surrogate = F.when(kind == "phone", F.ltrim(surrogate, F.lit("+"))).otherwise(surrogate)
    places = F.length(F.regexp_replace(value, "[^0-9]", ""))
    run = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda acc, c: F.when(
            c.rlike(_DIGIT), F.struct(F.concat(acc["out"], F.substring(surrogate, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))),
    )["out"]
    title = F.regexp_extract(value, rf"^(?:{TITLES})\.? ", 0)
    return (
        F.when((kind == "email") & (value == F.upper(value)), F.upper(surrogate))
        .when(kind.isin("email", "ip"), surrogate)
        .when(kind == "person", F.concat(title, F.split(surrogate, r"\|")[2]))
        .otherwise(F.concat(run, F.substring(surrogate, places + 1, F.length(surrogate))))
    )


def _longer(key: str, kind: Column, canon: Column) -> Column:
    """A surrogate that is longer than any entity of its kind."""
    first, more = _surrogate(key, kind, canon, F.lit(0)), _digits(key, F.lit(32), "rest", kind, canon)
    letters = F.translate(more, "0123456789", "abcdefghij")
    at = F.substring_index(first, "@", 1)
    return (
        F.when(kind == "email", F.concat(at, F.lit("."), letters, F.substring(first, F.length(at) + 1, F.length(first))))
        .when(kind == "person", F.concat(first, letters))
        .when(kind == "ip", F.concat(first, F.lit("."), more))
        .otherwise(F.concat(first, more))
    )


def _assign(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, canon, surrogate of distinct entities (kind, canon); distinct surrogates, none of them an entity."""
    todo = entities.select("kind", "canon")
    done: list[DataFrame] = []
    for attempt in range(MAX_ATTEMPTS):
        drawn = scratch.table(f"drawn-{attempt}", todo.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("canon"), F.lit(attempt))))
        taken = entities.select("kind", F.col("canon").alias("surrogate"))
        for d in done:
            taken = taken.union(d.select("kind", "surrogate"))
        free = drawn.join(taken.distinct(), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        done.append(scratch.table(f"named-{attempt}", first.select("kind", "canon", "surrogate")))
        todo = scratch.table(f"again-{attempt}", todo.join(done[-1], ["kind", "canon"], "left_anti"))
        if todo.isEmpty():
            break
    else:
        done.append(todo.withColumn("surrogate", _longer(key, F.col("kind"), F.col("canon"))))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with every entity in text replaced; other columns as they are."""
    return _replaced(docs, key).select(*docs.columns)


def _untitled(part: Column, names: Column) -> Column:
    """part with each full name of names, structs of name and new, replaced where it stands as words of its own."""
    return F.aggregate(names, part, lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}])"), x["name"], F.lit(r"(?![\p{L}])")), x["new"]))


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.col("text").cast("string")
    has = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    flagged = scratch.table(
        "flagged",
        docs.filter(has).withColumn("_tl_row", F.monotonically_increasing_id()).withColumn("_tl_found", F.regexp_extract_all(text, F.lit(ANY), 0)),
    )
    value = F.col("value")
    found = (
        flagged.select("_tl_row", F.posexplode("_tl_found").alias("at", "value"))
        .withColumn("kind", _kind(value))
        .withColumn("canon", _canonical(F.col("kind"), value))
    )
    found = scratch.table("found", found)
    entities = scratch.table("entities", found.filter("kind IS NOT NULL").select("kind", "canon").distinct())
    named = _assign(entities, scratch, key)
    person = (F.col("kind") == "person") & F.col("canon").contains(" ")
    put = (
        _surrogates_of(found, named)
        .withColumn("new", F.coalesce(_render(F.col("kind"), value, F.col("surrogate")), value))
        .groupBy("_tl_row")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_tl_new"),
            F.count("kind").alias("_tl_n"),
            F.array_sort(F.collect_set(F.when(person, F.struct(_name(value).alias("name"), F.split("surrogate", r"\|")[2].alias("new"))))).alias("_tl_names"),
        )
    )
    between = F.split(F.col("text").cast("string"), ANY, -1)
    between = F.when(F.size("_tl_names") == 0, between).otherwise(F.transform(between, lambda x: _untitled(x, F.col("_tl_names"))))
    new = F.concat(F.transform(F.col("_tl_new"), lambda x: x["new"]), F.array(F.lit("")))
    joined = flagged.join(put, "_tl_row").withColumn("text", F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), ""))
    return joined.select(*docs.columns, "_tl_n").unionByName(docs.filter(~has).select(*docs.columns, F.lit(0).cast("long").alias("_tl_n")))


def _surrogates_of(found: DataFrame, named: DataFrame, salts: int = 64) -> DataFrame:
    """found with surrogate. An entity that fills the documents would gather in one task, so occurrences are spread over salts and each surrogate goes to the salts that its entity has."""
    salted = found.withColumn("salt", F.pmod("_tl_row", F.lit(salts)))
    homes = salted.filter("kind IS NOT NULL").select("kind", "canon", "salt").distinct()
    return salted.join(homes.join(named, ["kind", "canon"]), ["kind", "canon", "salt"], "left")


def surrogate_documents(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with surrogates, and n_entities, the number of entities that were replaced in it."""
    return _replaced(docs.select("doc_id", "text"), key).select("doc_id", "text", F.col("_tl_n").alias("n_entities"))
