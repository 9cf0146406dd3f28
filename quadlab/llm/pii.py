"""Personal data replaced by keyed surrogates of the same kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quadlab.llm.common import cut, fresh, written

# Courtesy titles by gender (n: neither), particles of names, name endings by gender and script, and syllables by script.
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "Господин", "Г-н", "Sir", "Sr", "M."), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа", "Г-жа", "Mme", "Sra"), "n": ("Dr", "Prof")}
PARTICLES = ("von", "van", "der", "den", "zu", "de", "del", "della", "di", "da", "du", "la", "le", "ter")
ENDINGS = {"m_latin": ("or", "an", "ius", "elo"), "f_latin": ("ia", "ella", "ina", "ette"), "n_latin": ("is", "en", "ay", "el"), "n_cyrillic": ("ли", "не", "ро", "ши"),
           "m_cyrillic": ("ан", "ор", "ей", "ил"), "f_cyrillic": ("ина", "ия", "ела", "ана"),
           "s_latin": ("sson", "well", "mont", "ler"), "s_cyrillic": ("енко", "ский", "ин", "ук")}
SYLLABLES = {"latin": ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"),
             "cyrillic": ("ба", "ве", "ди", "жо", "зу", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "фо", "ху", "ша")}

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]++"
_BARE = rf"(?<![\p{{L}}'’-]){_NAME}"
_TITLE = "|".join(t.replace(".", r"(?=\.)") for g in TITLES.values() for t in sorted(g, key=len, reverse=True))
_MORE = rf"(?: (?:{_TITLE})\.?(?= ))*+"
#: Kinds in the order in which they are tried at one place. Repeated groups are possessive and e-mails begin at the start of their run (or after a match), so that
#: long runs of names, labels, letters or digits neither recurse nor are read again from each of their places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-])[A-Za-z0-9.-]*(?<=[A-Za-z0-9-])\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?|\([0-9]{2,4}\))(?:[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:[ .-][0-9]{2,4}){2,4})(?![0-9])"
             r"|(?<![0-9.-])(?:(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ -][0-9]{5,8}|0[0-9]{1,4}(?:[ -][0-9]{2,4}){2,4})(?![0-9.-]*[0-9])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.?{_MORE}(?:(?: (?:{'|'.join(PARTICLES)}|\p{{Lu}}\.))*+ {_NAME})++",
}
_ALL = "|".join(PATTERNS.values())
#: Texts without any of these hold no entity.
_HINT = "[0-9@]|" + "|".join(t.replace(".", r"\.") for g in TITLES.values() for t in g)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not again for each element of a lambda in ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind(m: Column) -> Column:
    """Kind of a whole match."""
    out = F.when(F.contains(m, F.lit("@")), "email")
    for k in ("iban", "card", "ip", "ssn", "phone"):
        out = out.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k)
    return out.otherwise("person")


def _titled(m: Column) -> tuple[Column, Column]:
    """Titles of a person with the space after them, and the names."""
    titles = F.regexp_extract(m, rf"^(?:{_TITLE})\.?{_MORE} ", 0)
    return titles, F.split(F.substr(m, F.length(titles) + 1), " ")


def _name(name: Column, surname: Column) -> Column:
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return F.struct(F.concat(F.when(surname, "s_").otherwise("g_"), script).alias("type"), F.lower(name).alias("name"))


def _particle(name: Column) -> Column:
    return name.isin(*PARTICLES)


def _person(m: Column) -> Column:
    """Names of a person as ``type, name, gender``, the last one the surname. A given name is one entity whatever the title before it; its gender is said by the titles that have one."""
    titles, names = _titled(m)

    def has(gender: str) -> Column:
        return titles.rlike("(?:^| )(?:" + "|".join(t.replace(".", r"\.") for t in TITLES[gender]) + r")\.? ")
    gender = F.when(has("f"), "f").when(has("m"), "m").otherwise("n")

    def entity(n: Column, surname: bool, gender: Column) -> Column:
        e = _name(n, F.lit(surname))
        return F.struct(e["type"].alias("type"), e["name"].alias("name"), gender.alias("gender"))

    def every(x: Column) -> Column:
        given = F.filter(F.slice(x["names"], F.lit(1), F.size(x["names"]) - 1), lambda n: ~_particle(n))
        return F.concat(F.transform(given, lambda n: entity(n, False, x["gender"])), F.array(entity(F.element_at(x["names"], -1), True, x["gender"])))

    return _once(F.struct(names.alias("names"), gender.alias("gender")), every)


def entities(m: Column) -> Column:
    """What a match refers to, in one spelling: ``type, name, gender`` (two for a full name). Spellings of one thing agree, so its surrogates do."""
    k = kind(m)
    plain = F.when(k == "email", F.lower(m)).when(k == "ip", m).otherwise(F.regexp_replace(m, "[ .()-]", ""))
    return F.when(k == "person", _person(m)).otherwise(F.array(F.struct(k.alias("type"), plain.alias("name"), F.lit("n").alias("gender"))))


def _digest(key: str, attempt: Column) -> Column:
    """Hex digits that depend on key, entity and attempt; enough for long names."""
    seed = F.concat_ws("\x1f", F.lit(key), F.col("type"), F.col("name"), attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(str(i))), 256) for i in range(3)])


def _nibble(h: Column, i: Column, n: int) -> Column:
    """A number below n from two hex digits."""
    return F.conv(F.substr(h, i * 2 % 180 + 1, F.lit(2)), 16, 10).cast("int") % n


def _luhn(digits: Column) -> Column:
    """Weighted sum of all digits, of which the last is the check digit."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)


def _mod97(s: Column) -> Column:
    """Remainder of the number that capitals and digits spell, A being 10."""
    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def surrogate(key: str, attempt: Column) -> Column:
    """Replacement of the entity in columns ``type``, ``name`` and ``gender``.

    Characters are replaced by others of their class; an e-mail keeps its last domain label, an IBAN its country, phones and cards their first digit,
    and a card number or IBAN that passes its check gets one that passes, another one that does not. From the twentieth attempt on, forms grow.
    """
    return _once(_digest(key, attempt), lambda h: _once(F.length("name"), lambda n: _drawn(h, n, attempt)))


def _drawn(h: Column, length: Column, attempt: Column) -> Column:
    """The surrogate from hex digits and the length of the name."""
    name, type_ = F.col("name"), F.col("type")
    chars = F.split(name, "")
    keep = F.when(type_ == "iban", 2).when((type_ == "card") | ((type_ == "phone") & F.startswith(name, F.lit("+"))), 2 - (type_ == "card").cast("int")).when((type_ == "phone") & F.startswith(name, F.lit("0")), 1).when((type_ == "phone") & F.startswith(name, F.lit("1")) & (F.length(name) == 11), 1).otherwise(0)
    last = F.when(type_ == "email", F.length(F.regexp_extract(name, r"\.[^.]*$", 0))).otherwise(0)

    def swap(c: Column, i: Column, x: Column) -> Column:
        v = _nibble(h, i, 256)
        other = (F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike("[a-z]"), F.char(v % 26 + 97)).when(c.rlike("[A-Z]"), F.char(v % 26 + 65)).otherwise(c))
        return F.when((i < x["keep"]) | (i >= length - x["last"]), c).otherwise(other)

    swapped = _once(F.struct(keep.alias("keep"), last.alias("last")), lambda x: F.array_join(F.transform(chars, lambda c, i: swap(c, i, x)), ""))
    body = F.substr(swapped, F.lit(1), length - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, ((check + F.when(_luhn(name) % 10 == 0, 0).otherwise(1)) % 10).cast("string"))
    bban = F.substr(swapped, F.lit(5))
    digits = (98 - _mod97(F.concat(bban, F.substr(name, F.lit(1), F.lit(2)), F.lit("00"))) + F.when(_mod97(F.concat(F.substr(name, F.lit(5)), F.substr(name, F.lit(1), F.lit(4)))) == 1, 0).otherwise(1))
    iban = F.concat(F.substr(name, F.lit(1), F.lit(2)), F.lpad(digits.cast("string"), 2, "0"), bban)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_nibble(h, i, 254) + 1).cast("string")), ".")

    def named(script: str, role: str) -> Column:
        def array(role: str) -> Column:
            return F.array(*map(F.lit, ENDINGS[f"{role}_{script}"]))
        syllables, endings = F.array(*map(F.lit, SYLLABLES[script])), array("s")
        if role == "g":
            endings = F.when(F.col("gender") == "f", array("f")).when(F.col("gender") == "m", array("m")).otherwise(array("n"))
        stem = F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: F.get(syllables, _nibble(h, i, 16)))
        return F.concat(F.array_join(stem, ""), F.get(endings, _nibble(h, F.lit(80), 4)))

    out = F.when(type_ == "ip", ip).when(type_ == "card", card).when(type_ == "iban", iban)
    for role in ("g", "s"):
        for script in SYLLABLES:
            out = out.when(type_ == f"{role}_{script}", named(script, role))
    longer = F.when((attempt >= 20) & ~F.contains(type_, F.lit("_")), (attempt - 19).cast("string")).otherwise("")
    out = out.otherwise(swapped)
    return F.when(type_ == "email", F.concat(longer, out)).otherwise(F.concat(out, longer))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``type, name, other``: one surrogate for each distinct entity, of the gender that most of its mentions have; no two entities of a type share one, and none is itself an entity of the table.

    Surrogates that collide are drawn again with the next attempt, until none does; each round is checkpointed.
    """
    gender = F.sum((F.col("gender") == "f").cast("int") - (F.col("gender") == "m").cast("int"))
    todo = cut(found.groupBy("type", "name").agg(F.when(gender > 0, "f").when(gender < 0, "m").otherwise("n").alias("gender")))
    known = todo
    done: DataFrame | None = None
    attempt = 0
    while attempt == 0 or todo.take(1):
        drawn = cut(todo.withColumn("other", surrogate(key, F.lit(attempt))))
        taken = known.select("type", F.col("name").alias("other"))
        if done is not None:
            taken = taken.unionByName(done.select("type", "other"))
        free = drawn.join(taken, ["type", "other"], "left_anti").groupBy("type", "other").agg(F.min("name").alias("name"))
        free = cut(free.select("type", "name", "other"))
        done = free if done is None else cut(done.unionByName(free))
        todo = cut(todo.join(free.select("type", "name"), ["type", "name"], "left_anti"))
        attempt += 1
    return done


def _placed(m: Column, other: Column) -> Column:
    """A surrogate in the spelling of a match: same separators, same capitals."""
    k = kind(m)
    strip = F.regexp_replace(m, "[ .()-]", "")
    n = F.length(strip)
    at = F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[ .()-]"), c).otherwise(
        F.substr(other, F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[ .()-]", "")), F.lit(1))))
    spaced = F.concat(F.array_join(at, ""), F.substr(other, n + 1))
    mail = F.when(m == F.upper(m), F.upper(other)).otherwise(other)
    return F.when(k == "email", mail).when(k == "ip", other).otherwise(spaced)


def _named(name: Column, other: Column) -> Column:
    """A surrogate in the capitals of a name, or its initial for an initial."""
    return (F.when(F.endswith(name, F.lit(".")), F.concat(F.substr(F.initcap(other), F.lit(1), F.lit(1)), F.lit(".")))
            .when((name == F.upper(name)), F.upper(other)).otherwise(F.initcap(other)))


def _other(known: Column, type_: Column, name: Column) -> Column:
    return F.try_element_at(known, F.concat_ws("\x1f", type_, name))


def _rendered(m: Column, known: Column) -> Column:
    titles, names = _titled(m)

    def shown(n: Column, surname: bool) -> Column:
        e = _name(n, F.lit(surname))
        return F.when(_particle(n), n).otherwise(_named(n, _other(known, e["type"], e["name"])))

    def full(names: Column) -> Column:
        given = F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda n: shown(n, False))
        return F.array_join(F.concat(given, F.array(shown(F.element_at(names, -1), True))), " ")

    person = F.concat(titles, _once(names, full))
    first = F.get(entities(m), 0)
    return F.when(kind(m) == "person", person).otherwise(_placed(m, _other(known, first["type"], first["name"])))


def _bare(text: Column, known: Column) -> Column:
    """A stretch of text without matches, in which the names of persons of the same document are replaced where they stand alone."""
    def shown(w: Column) -> Column:
        n = F.regexp_replace(w, "['’]s$", "")
        other = F.coalesce(*[_other(known, e["type"], e["name"]) for e in (_name(n, F.lit(True)), _name(n, F.lit(False)))])
        return F.coalesce(F.concat(_named(n, other), F.substr(w, F.length(n) + 1)), w)
    words = F.transform(F.regexp_extract_all(text, F.lit(_BARE), F.lit(0)), shown)
    persons = F.exists(F.map_keys(known), lambda k: F.startswith(k, F.lit("s_")))
    return F.when(persons, F.array_join(F.zip_with(F.split(text, _BARE, -1), words, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))), "")).otherwise(text)


def matches(text: Column) -> Column:
    """All entities of a text, leftmost first."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(none)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and the kinds found in a new last column ``entity_kinds`` (one per match).

    Kinds are those of ``PATTERNS``; a person is found by a courtesy title, and bare mentions of the names in the same text are replaced as well (they have no entry among the kinds). Surrogates depend on ``key`` and the entity alone unless they collide; the same entity
    gets the same surrogate in every document and spelling. A null text stays null and has no kinds; repeated rows are treated
    alike; other columns pass through; an empty table gives no rows.
    """
    if "entity_kinds" in {c.lower() for c in docs.columns}:
        raise ValueError("column entity_kinds is taken")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("text is not null")
    seen = rows.select("doc_id", "h", F.array_distinct(matches(F.col("text"))).alias("m")).where("size(m) > 0")
    found = written(seen.select("doc_id", "h", F.explode(F.array_distinct(F.flatten(F.transform("m", entities)))).alias("e"))
                    .select("doc_id", "h", "e.type", "e.name", "e.gender"))
    others = surrogates(found, key)
    d, t, k, h = (fresh(docs.columns, x) for x in ("__d", "__t", "__known", "__h"))
    pair = F.struct(F.concat_ws("\x1f", "type", "name").alias("key"), F.col("other").alias("value"))
    known = (found.join(others, ["type", "name"]).groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_set(pair)).alias(k))
             .select(F.col("doc_id").alias(d), F.col("h").alias(t), k))
    both = docs.withColumn(h, F.xxhash64("text")).join(known, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    found_here = F.regexp_extract_all("text", F.lit(_ALL), F.lit(0))
    pieces = F.zip_with(F.split("text", _ALL, -1), F.transform(found_here, lambda m: _rendered(m, F.col(k))),
                        lambda g, m: F.concat(_bare(F.coalesce(g, F.lit("")), F.col(k)), F.coalesce(m, F.lit(""))))
    text = F.when(F.col(k).isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    kinds = F.when(F.col(k).isNull(), F.array().cast("array<string>")).otherwise(F.transform(found_here, kind))
    return both.select(*[text.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns], kinds.alias("entity_kinds"))
