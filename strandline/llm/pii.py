"""PII: detected entities get keyed surrogates of the same type, format, script and gender. DataFrame functions only.

A surrogate is a function of the key, the entity and a number of attempts, 0 for nearly all. Collisions are looked for over all
entities of the corpus; only entities that need a further attempt are joined back to their documents.

A person is a surname and, where it is said, a given name. Surnames have surrogates of their own, and given names have them within
a surname, so "Mr John Smith", "Dr Smith" and a later "John Smith" or "Smith" stay one person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Sra", "г-жа", "κα"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κος"),
    "n": ("Dr", "Doctor", "Prof", "Professor"),
}
_TITLE = "(?:" + "|".join(t for own in _TITLES.values() for t in own) + r")\.? "
_NAME = r"\p{Lu}\p{Ll}+"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Types and their patterns, in order of precedence at one place. No pattern has a group that captures; each begins where no
#: letter of ASCII, digit or underscore stands before, with one of these, a plus sign, a colon or a letter of a title.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![\w])(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<![\w+])\+[1-9](?:[ .-]?\d){7,14}(?![\w])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){14,15}(?![\w-])",
    "national": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "ip6": rf"(?<![\w.:])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])",
    "person": rf"(?<!\w){_TITLE}{_NAME}(?:[ -]{_NAME})?",
}
#: One look behind and one ahead tell most places from a beginning before any pattern is tried.
ANY = r"(?<!\w)(?=[\w+κг])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Given names by script and gender, and the syllables of surnames, which serve both genders; Cyrillic ones take an ending by gender.
GIVEN = {
    "latin": {"f": ("Anna", "Clara", "Elena", "Emma", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera", "Zoe"), "m": ("Adam", "Bruno", "Carlos", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Noah", "Oscar", "Paul", "Simon", "Victor")},
    "cyrillic": {"f": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"), "m": ("Антон", "Борис", "Виктор", "Денис", "Иван", "Михаил", "Олег", "Павел")},
    "greek": {"f": ("Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία", "Χριστίνα"), "m": ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος")},
}
SYLLABLES = {
    "latin": ("ba", "ce", "do", "fa", "ga", "ke", "la", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"),
    "cyrillic": ("ба", "во", "га", "де", "жи", "зо", "ка", "ле", "ма", "но", "пе", "ро", "са", "ту", "фе", "хо"),
    "greek": ("βα", "γο", "δε", "ζα", "θο", "κα", "λε", "μα", "νο", "πε", "ρι", "σα", "τα", "φο", "χα", "ψε"),
}
_ENDS = {"latin": ("n", "r", "l", "s"), "cyrillic": ("в", "в", "в", "в"), "greek": ("ς", "ς", "ς", "ς")}
#: Rows that may be broadcast: exceptions, at some hundred bytes each.
BROADCAST_ROWS = 50_000
#: Attempts in an entity's own form, before telephone numbers and long addresses get longer; rounds of attempts.
OWN_FORM, ROUNDS = 3, 20


def let(value: Column, body) -> Column:
    """body of value, which is made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind(entity: Column) -> Column:
    """The type of what ANY has matched; null, so no entity, for numbers of a card's form whose Luhn sum fails."""
    out = F
    for name, pattern in PATTERNS.items():
        is_ = entity.rlike(f"^(?:{pattern})$")
        if name == "card":
            out = out.when(is_, F.when(_luhn_rest(F.regexp_replace(entity, r"\D", "")) == 0, name))
        else:
            out = out.when(is_, name)
    return out


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def person(entity: Column) -> Column:
    """title (with its dot and space), given (or empty), family, stem, script, gender of a titled name.

    The first of two words is the given name. A gender that the title does not say is a guess by the given name's end. The
    stem of a Cyrillic surname is without the ending of women's.
    """
    title = F.regexp_extract(entity, "^" + _TITLE, 0)
    rest = F.regexp_replace(entity, "^" + _TITLE, "")
    given = F.when(F.instr(rest, " ") > 0, F.substring_index(rest, " ", 1)).otherwise("")
    bare = F.regexp_replace(title, r"[. ]", "")
    gender = F.when(bare.isin(*_TITLES["f"]), "f").when(bare.isin(*_TITLES["m"]), "m").when(given.rlike("[aeаяαη]$"), "f").otherwise("m")
    parts = F.struct(title.alias("title"), given.alias("given"), F.substring_index(rest, " ", -1).alias("family"), _script(rest).alias("script"), gender.alias("gender"))

    def stemmed(p: Column) -> Column:
        stem = F.when((p["script"] == "cyrillic") & (p["gender"] == "f"), F.regexp_replace(p["family"], "а$", "")).otherwise(p["family"])
        return F.struct(p["title"].alias("title"), p["given"].alias("given"), p["family"].alias("family"), stem.alias("stem"), p["script"].alias("script"), p["gender"].alias("gender"))

    return let(parts, stemmed)


def people(found: Column) -> Column:
    """The persons of a text's matches, those with given names first."""
    all_ = F.array_distinct(F.transform(F.filter(found, lambda e: F.coalesce(kind(e) == "person", F.lit(False))), person))
    return F.concat(F.filter(all_, lambda p: p["given"] != ""), F.filter(all_, lambda p: p["given"] == ""))


def with_names(persons: Column) -> Column:
    """The pattern of a text's entities: ANY, and its persons without a title, by both names or the surname."""
    forms = F.array_distinct(F.concat(F.transform(F.filter(persons, lambda p: p["given"] != ""), lambda p: F.concat(p["given"], F.lit(" "), p["family"])), F.transform(persons, lambda p: p["family"])))
    return F.concat(F.lit(ANY + r"|(?<![\p{L}\w-])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\w-])"))


def canonical(kind_: Column, entity: Column) -> Column:
    """What makes two mentions the same: lower case for e-mail, secrets and long addresses, digits for numbers."""
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when(kind_.isin("email", "secret", "ip6"), F.lower(entity))
        .when(kind_.isin("card", "phone", "national"), digits)
        .when(kind_ == "iban", F.regexp_replace(entity, " ", ""))
        .otherwise(entity)
    )


def surname(p: Column) -> Column:
    return F.concat(p["script"], F.lit("|"), p["stem"])


def given_name(p: Column) -> Column:
    return F.concat(p["script"], F.lit("|"), p["gender"], F.lit("|"), p["stem"], F.lit("|"), p["given"])


def _number(digest: Column, at: int, below: int) -> Column:
    """A number below 2 ** 20 from hexadecimal digits at (from 0) of a digest."""
    return F.conv(F.substring(digest, at * 4 + 1, 8), 16, 10).cast("long") % below


def _luhn_rest(digits: Column) -> Column:
    """Sum of Luhn's digits modulo 10; the last digit has weight one."""
    n = F.length(digits)

    def weighed(c, i):
        d = c.cast("int") * F.when((n - 1 - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), weighed), F.lit(0), lambda a, x: a + x) % 10


def _renewed(text: Column, digest: Column, keep: Column) -> Column:
    """text with every digit, and every letter, replaced by another of its sort; its first keep characters stay."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def change(c, i):
        at = F.conv(F.substring(digest, (i % 59 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")
        letter = lambda alphabet: F.substring(F.lit(alphabet), (at % 26 + 1).cast("int"), F.lit(1))
        return F.when(i < keep, c).when(c.rlike("[0-9]"), (at % 10).cast("string")).when(c.rlike("[a-z]"), letter(lower)).when(c.rlike("[A-Z]"), letter(upper)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), change), "")


def _digit(digest: Column, at: Column) -> Column:
    """A hexadecimal digit of a digest as a number; at is from 0."""
    return F.conv(F.substring(digest, at + 1, F.lit(1)), 16, 10).cast("int")


def _surname(script: str, digest: Column, parts: Column) -> Column:
    """A name of parts syllables, so of one of 16 ** parts."""
    syllables = F.array(*map(F.lit, SYLLABLES[script]))
    name = F.array_join(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.element_at(syllables, _digit(digest, k.cast("int")) + 1)), "")
    return F.concat(F.initcap(name), F.element_at(F.array(*map(F.lit, _ENDS[script])), _digit(digest, F.lit(63)) % 4 + 1))


def _given(script: str, gender: str, digest: Column, parts: Column) -> Column:
    names = F.array(*map(F.lit, GIVEN[script][gender]))
    return F.array_join(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.element_at(names, _digit(digest, k.cast("int")) % len(GIVEN[script][gender]) + 1)), "-")


def surrogate(kind_: Column, canon: Column, attempts: Column, key: str, syllables: int) -> Column:
    """What stands for a canonical entity: same type, length and country, same script and gender.

    Cards keep their first digit and Luhn's sum, bank accounts their country and check digits that hold, phones their country
    code; addresses stay addresses; e-mail has a letter for a letter and a domain under example.com, the same for the same
    domain. Surnames have syllables syllables and one more an attempt, given names one name an attempt, so names never run
    out. Nor do telephone numbers and addresses with colons: beyond OWN_FORM attempts a number has a digit more an attempt, up to 15,
    and an address groups of four digits. A given name's surrogate stands after its script, gender and surname.
    """
    made = F.sha2(F.concat_ws("|", F.lit(key), kind_, canon, attempts.cast("string")), 256)
    return let(made, lambda digest: _surrogate(kind_, canon, attempts, digest, key, syllables))


def _surrogate(kind_: Column, canon: Column, attempts: Column, digest: Column, key: str, syllables: int) -> Column:
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 256)
    email = F.concat(_renewed(F.substring_index(canon, "@", 1), digest, F.lit(0)), F.when(attempts > 3, F.substring(digest, 1, 6)).otherwise(""), F.lit("@m"), F.substring(domain, 1, 8), F.lit(".example.com"))
    card = let(_renewed(canon, digest, F.lit(1)), _card)
    ip = F.concat_ws(".", (_number(digest, 0, 222) + 1).cast("string"), *(_number(digest, k, 256).cast("string") for k in (2, 4)), (_number(digest, 6, 254) + 1).cast("string"))
    hexed = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(digest, (i % 61 + 1).cast("int"), F.lit(1)))), "")
    long_groups = F.array_join(F.transform(F.split(canon, ":"), lambda c, i: F.when(c == "", c).otherwise(F.substring(digest, (i * 5 + 1).cast("int"), F.lit(4)))), ":")
    further = F.greatest(F.lit(0), F.least(attempts - OWN_FORM, 15 - F.length(canon))).cast("int")
    number = _renewed(F.concat(canon, F.repeat(F.lit("0"), further)), digest, F.length(F.regexp_extract(canon, COUNTRY_CODE, 0)))
    script, gender = F.substring_index(canon, "|", 1), F.element_at(F.split(canon, r"\|"), 2)
    family, given = F, F
    for s in GIVEN:
        family = family.when(script == s, F.concat(F.lit(f"{s}|"), _surname(s, digest, attempts + syllables)))
        for g in "fm":
            given = given.when((script == s) & (gender == g), _given(s, g, digest, attempts + 1))
    return (
        F.when(kind_ == "email", email)
        .when(kind_ == "card", card)
        .when(kind_ == "ip", ip)
        .when(kind_ == "ip6", F.when(attempts > OWN_FORM, long_groups).otherwise(hexed))
        .when(kind_ == "family", family)
        .when(kind_ == "given", F.concat(F.regexp_replace(canon, r"[^|]*$", ""), given))
        .when(kind_ == "phone", number)
        .when(kind_ == "iban", let(_renewed(canon, digest, F.lit(4)), _account))
        .when(kind_ == "secret", F.substring(digest, F.lit(1), F.length(canon)))
        .otherwise(_renewed(canon, digest, F.lit(0)))
    )


#: The country codes of telephone numbers, of one digit, of two, else of three.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _card(fresh: Column) -> Column:
    """fresh with its last digit set so that Luhn's sum holds."""
    body = F.substring(fresh, F.lit(1), F.length(fresh) - 1)
    return let(F.concat(body, F.lit("0")), lambda zero: F.concat(F.substring(zero, F.lit(1), F.length(zero) - 1), ((10 - _luhn_rest(zero)) % 10).cast("string")))


def _account(fresh: Column) -> Column:
    """fresh with the check digits, its third and fourth characters, that make it 1 modulo 97 (letters count from 10, country last)."""
    moved = F.concat(F.substring(fresh, F.lit(5), F.length(fresh)), F.substring(fresh, 1, 2), F.lit("00"))

    def more(rest: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    rest = F.aggregate(F.split(moved, ""), F.lit(0), more)
    return F.concat(F.substring(fresh, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(fresh, F.lit(5), F.length(fresh)))


def formatted(kind_: Column, entity: Column, put: Column) -> Column:
    """The surrogate put in the mention's own format: its separators, or a secret's letters' case."""
    spread = F.aggregate(
        F.split(entity, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda a, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(a["out"], F.substring(put, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
        lambda a: F.concat(a["out"], F.substring(put, a["n"] + 1, F.length(put))),
    )
    # where lower and upper case are mixed, each letter takes the case that the entity has at its place
    mixed = F.array_join(F.transform(F.split(entity, ""), lambda c, i: let(F.substring(put, i + 1, F.lit(1)), lambda x: F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x))), "")
    cased = F.when(entity == F.lower(entity), put).when(entity == F.upper(entity), F.upper(put)).otherwise(mixed)
    return F.when(kind_.isin("card", "phone", "national", "iban"), spread).when(kind_.isin("secret", "ip6"), cased).otherwise(put)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, kind, canon of every mention in docs (doc_id, text); a person gives its surname and, if it has one, its given name."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0))).alias("entity"))
    # a generator of one row keeps the condition above it
    found = found.select("doc_id", "entity", F.explode(F.array(kind(F.col("entity")))).alias("kind")).where("kind is not null")

    def of_person(p: Column) -> Column:
        both = F.array(F.struct(F.lit("family").alias("kind"), surname(p).alias("canon")), F.struct(F.lit("given").alias("kind"), given_name(p).alias("canon")))
        return F.when(p["given"] == "", F.slice(both, 1, 1)).otherwise(both)

    plain = F.array(F.struct("kind", canonical(F.col("kind"), F.col("entity")).alias("canon")))
    return found.select("doc_id", F.inline(F.when(F.col("kind") == "person", let(person(F.col("entity")), of_person)).otherwise(plain)))


def syllables_for(surnames: int) -> int:
    """As many that there are 256 times as many names as surnames, or more: few of them need a further attempt."""
    n = 3
    while 16 ** (n - 2) < surnames:
        n += 1
    return n


def _form(kind_: Column, canon: Column) -> Column:
    """What an entity shares with those that could stand for it: its country, script or first digit, and where it has digits and letters."""
    mask = F.regexp_replace(F.regexp_replace(canon, "[0-9]", "0"), "[a-z]", "a")
    return (
        F.when(kind_ == "card", F.concat(F.substring(canon, 1, 1), mask))
        .when(kind_ == "iban", F.concat(F.substring(canon, 1, 2), mask))
        .when(kind_ == "phone", F.concat(F.regexp_extract(canon, COUNTRY_CODE, 0), mask))
        .when(kind_ == "ip6", F.regexp_replace(canon, "[0-9a-f]", "0"))
        .when(kind_ == "given", F.regexp_replace(canon, r"[^|]*$", ""))
        .when(kind_ == "family", F.substring_index(canon, "|", 1))
        .when(kind_ == "ip", "")
        .otherwise(mask)
    )


def exceptions(mentions: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(kind, canon, put) of the entities whose surrogate at attempt 0 is a real entity or another's surrogate; the syllables of surnames.

    Each round tries the open entities once more: a surrogate that no entity of the corpus is, that no earlier round gave away,
    and of several equal ones that of the smallest entity, is settled. Rounds see fewer and fewer entities, and end when none
    is open. One number comes to the driver a round.

    A form can be full: a corpus may hold nearly every value that it has. Entities still open after ROUNDS rounds, and all others of
    their forms, exchange their values in an order by keyed hashes, each taking that of the next: distinct still, none its own,
    but real. Where a form's only entity is left so, ValueError tells it.
    """
    all_ = scratch.written(mentions.select("kind", "canon").distinct(), "entities")
    syllables = syllables_for(all_.where("kind = 'family'").count())
    settled, open_ = None, all_
    for attempt in range(ROUNDS):
        tried = open_.withColumn("put", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key, syllables))
        real = all_.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
        taken = real if settled is None else real.union(settled.select("kind", "put"))
        tried = scratch.written(tried.join(taken, (F.col("kind") == F.col("k")) & (F.col("put") == F.col("c")), "left").select("kind", "canon", "put", F.col("c").isNull().alias("new")).distinct(), "tried")
        first = tried.where("new").groupBy("kind", "put").agg(F.min("canon").alias("canon"))
        now = scratch.written(first.select("kind", "canon", "put", F.lit(attempt).alias("attempts")), "settled")
        settled = now if settled is None else settled.union(now)
        open_ = scratch.written(tried.select("kind", "canon").join(now.select("kind", "canon"), ["kind", "canon"], "left_anti"), "open")
        if open_.isEmpty():
            return settled.where("attempts > 0").select("kind", "canon", "put"), syllables
    form = _form(F.col("kind"), F.col("canon")).alias("form")
    full = open_.select("kind", form).distinct()
    members = scratch.written(all_.withColumn("form", form).join(full, ["kind", "form"], "left_semi").withColumn("o", F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon"), 256)), "full")
    turned = scratch.written(_next_of(members), "turned")
    if not turned.where("put = canon").isEmpty():
        raise ValueError("a form of entities has one entity and no other value")
    rest = settled.where("attempts > 0").join(turned, ["kind", "canon"], "left_anti")
    return rest.select("kind", "canon", "put").union(turned.select("kind", "canon", "put")), syllables


def _next_of(members: DataFrame, cuts: int = 256) -> DataFrame:
    """kind, canon, put: for each of members (kind, form, canon, o) the canon that comes next by o in its form, after the last the first.

    Forms may be large, so windows run over the cuts of each form by o's first digits; the first of a cut follows the last of the one
    before, which needs one row a cut.
    """
    cut = members.withColumn("cut", F.floor(F.conv(F.substring("o", 1, 4), 16, 10).cast("long") * cuts / 65536).cast("int"))
    own = Window.partitionBy("kind", "form", "cut").orderBy("o")
    inner = cut.withColumn("put", F.lead("canon").over(own))
    firsts = cut.groupBy("kind", "form", "cut").agg(F.min_by("canon", "o").alias("first"))
    form = Window.partitionBy("kind", "form").orderBy("cut")
    whole = form.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select("kind", "form", "cut", F.coalesce(F.lead("first").over(form), F.first("first").over(whole)).alias("follows"))
    return inner.join(follows, ["kind", "form", "cut"]).select("kind", "canon", F.coalesce("put", "follows").alias("put"))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs in their own columns with surrogates in text, and the columns __p_n (entities, long) and __p_kinds (sorted, distinct).

    docs: doc_id, text and any others. Types are those of PATTERNS; the longest list of them is tried at each place in order.
    Persons are found by titles; in a text with one, the same names without a title are found too. The same
    entity has the same surrogate everywhere, in the format of each mention; different entities have different ones, none of
    which is an entity of the corpus, unless a form of entities is full (see exceptions). Null text stays null with 0 entities; empty text stays empty. Rows that repeat a doc_id
    are handled each; a null doc_id is an id as any other. key: secret; another key gives other surrogates.

    Texts are searched twice, once for the entities of the corpus and once for the result; they are shuffled only where more
    than BROADCAST_ROWS documents hold an entity that needs a further attempt.
    """
    with Scratch(docs.sparkSession, "pii") as scratch:
        mentions = scratch.written(entities(docs.select("doc_id", "text")).distinct(), "mentions")
        extra, syllables = exceptions(mentions, key, scratch)
        held = mentions.join(scratch.written(extra, "exceptions"), ["kind", "canon"])
        maps = written(held.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "put"))).alias("__p_more")), "overrides")
    maps = maps.withColumnRenamed("doc_id", "__p_id")
    n = maps.count()
    out = docs.join(F.broadcast(maps) if n <= BROADCAST_ROWS else maps, docs["doc_id"].eqNullSafe(F.col("__p_id")), "left") if n else docs.withColumn("__p_more", F.lit(None).cast("map<string,string>"))
    out = out.withColumn("__p_titled", F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0)))
    # generators of one row: what is made before them is made once
    made = F.when(F.size("__p_titled") > 0, people(F.col("__p_titled"))).otherwise(F.lit(None))
    out = out.withColumn("__p_people", F.explode(F.array(made)))
    named = F.size("__p_people") > 0
    out = out.withColumn("__p_pattern", F.explode(F.array(F.when(named, with_names(F.col("__p_people"))).otherwise(F.lit(ANY)))))
    some = F.size("__p_titled") > 0
    out = out.withColumn("__p_found", F.when(named, F.regexp_extract_all(F.col("text"), F.col("__p_pattern"), F.lit(0))).otherwise(F.col("__p_titled")))
    out = out.withColumn("__p_parts", F.when(some, F.split("text", F.col("__p_pattern"), -1)))

    def stand_in(kind_: Column, canon: Column) -> Column:
        return F.coalesce(F.element_at("__p_more", F.concat_ws("|", kind_, canon)), surrogate(kind_, canon, F.lit(0), key, syllables))

    def of_person(p: Column) -> Column:
        ending = F.when((p["script"] == "cyrillic") & (p["stem"] != p["family"]), "а").otherwise("")
        family = F.concat(F.substring_index(stand_in(F.lit("family"), surname(p)), "|", -1), ending)
        given = F.when(p["given"] == "", "").otherwise(F.concat(F.substring_index(stand_in(F.lit("given"), given_name(p)), "|", -1), F.lit(" ")))
        return F.concat(p["title"], given, family)

    def untitled(entity: Column) -> Column:
        """The person of the text that entity, both names or a surname, is; null if none."""
        same = F.filter("__p_people", lambda p: p["family"] == F.substring_index(entity, " ", -1))
        p = F.coalesce(F.get(F.filter(same, lambda p: F.concat(p["given"], F.lit(" "), p["family"]) == entity), 0), F.get(F.filter(same, lambda p: p["family"] == entity), 0))
        given = F.when(F.instr(entity, " ") > 0, p["given"]).otherwise("")
        return F.when(p.isNotNull(), F.struct(F.lit("").alias("title"), given.alias("given"), *(p[c].alias(c) for c in ("family", "stem", "script", "gender"))))

    def put(entity: Column) -> Column:
        def with_kind(k: Column) -> Column:
            plain = let(canonical(k, entity), lambda c: formatted(k, entity, stand_in(k, c)))
            known = F.struct(k.alias("kind"), F.when(k == "person", let(person(entity), of_person)).otherwise(plain).alias("put"))
            name = let(untitled(entity), lambda p: F.when(p.isNotNull(), F.struct(F.lit("person").alias("kind"), of_person(p).alias("put"))))
            return F.coalesce(F.when(k.isNotNull(), known), name, F.struct(F.lit(None).cast("string").alias("kind"), entity.alias("put")))

        return let(kind(entity), with_kind)

    out = out.withColumn("__p_put", F.explode(F.array(F.when(some, F.transform("__p_found", put)))))
    joined = F.array_join(F.transform("__p_parts", lambda part, i: F.concat(part, F.coalesce(F.get("__p_put", i)["put"], F.lit("")))), "")
    text = F.when(some, joined).otherwise(F.col("text"))
    types = F.filter(F.transform("__p_put", lambda x: x["kind"]), lambda k: k.isNotNull())
    out = out.withColumn("__p_types", F.when(some, types).otherwise(F.array().cast("array<string>")))
    n_found, kinds = F.size("__p_types").cast("long"), F.array_sort(F.array_distinct("__p_types"))
    return out.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns), n_found.alias("__p_n"), kinds.alias("__p_kinds"))
