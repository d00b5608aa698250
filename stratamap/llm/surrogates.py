"""Personal data replaced by keyed surrogates, in SQL functions only.

Detected: email addresses, phone numbers, IPv4 addresses, payment card numbers, social security numbers, IBANs, long
hexadecimal secrets, and names of persons after a title or with a known given name in front of another name.

Each distinct atom (an address, a number, a given name, a family name) is replaced everywhere by one surrogate, so
coreference holds: "Mr John Smith" and "John Smith" stay one person, whose family keeps one name. A surrogate is drawn from
SHA-256 of the secret key, the atom and an attempt number. It keeps the format: letters become letters of the same script
and case, digits digits, and the rest stays; a number that passes the Luhn check gets a surrogate that does and any other
one that does not; an octet keeps its number of digits; a given name is replaced by one of the same gender and script, a
family name by one of its script. The check for collisions is over all atoms of a kind: of atoms that draw the same
surrogate one keeps it, a surrogate may not be an atom that really occurs, and the rest draw again until all differ.
Where a format runs out of values, later attempts draw longer ones (or octets of any size).

Only documents with entities are joined; the texts of the others are never shuffled.

Nulls: a null text stays null, an empty one empty, both without entities. Ids take no part: rows with null or repeated doc_ids
are rows like others, and equal texts get equal surrogates. A very long text costs in proportion to its length and its
entities. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free, stored, table

#: The key where a call or the session names none; whoever knows it can draw the same surrogates.
KEY, KEY_SETTING = "surrogates-v1", "spark.stratamap.surrogates.key"
# Given names by gender and script, and parts that family names are made of.
GIVEN = {
    ("f", "latin"): "Alice Amélie Anna Barbara Carmen Charlotte Clara Elena Emma Eva Hannah Isabel Julia Laura Lucía Marie Mary Nina Olivia Paula Sarah Sofía Sophie Susan".split(),
    ("m", "latin"): "Adam Andreas Carlos Daniel David Diego Felix Hans Henri James Javier John Jonas José Jürgen Louis Lucas Manuel Michael Paul Peter Pierre Robert Thomas".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина Светлана".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Николай Олег Павел Сергей".split(),
    ("f", "greek"): "Άννα Δήμητρα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(),
}
FAMILY = {
    "latin": ("Ash Beck Brand Cald Dorn Eller Fair Gold Hart Holm Kessel Lang Mar Nor Ober Pem Quin Rosen Stein Thorn Val Wald West Win".split(), "berg by croft dale field ford hoff ley lin man mond ner shaw son stad ton ville well wood".split()),
    "cyrillic": ("Бел Вол Гор Дуб Зим Кар Лес Мор Нов Орл Пет Руд Сол Тих".split(), "ак енко ин ицын ский ов овский ук".split()),
    "greek": ("Αλεξ Βασιλ Γεωργ Δημ Θεο Καρ Λαμπρ Μαρ Νικολ Παπ Σταυρ".split(), "άκης αρας ίδης όγλου όπουλος ούλης".split()),
}
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Doña", "госпожа", "Κυρία"), "": ("Dr", "Prof")}
_titles = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_given = "|".join(sorted((n for ns in GIVEN.values() for n in ns), key=len, reverse=True))
_name = r"\p{Lu}(?:['’]\p{Lu})?[\p{Ll}\p{Mn}]+(?:\p{Lu}[\p{Ll}\p{Mn}]+)*(?:-\p{Lu}\p{Ll}+)?"
#: Kinds in the order that they are tried at a place.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?![\d-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)",
    "name": rf"(?<!\p{{L}})(?:(?:{_titles})\.?\h{_name}(?:\h{_name}){{0,3}}+|(?:{_given})\h{_name}(?:\h{_name}){{0,2}}+)(?!\p{{L}})",
}
#: An entity begins at the beginning of a word; only the kinds that can begin with its first character are tried.
_starts = {r"[A-Za-z0-9._%]": ("email",), r"[\d(+]": ("ip", "ssn", "card", "phone"), r"[0-9a-fA-F]": ("secret",), r"[A-Z]": ("iban",), r"[\p{Lu}г]": ("name",)}
PATTERN = r"(?<![\p{L}\p{N}_])(?:" + "|".join(f"(?={c})(?:{'|'.join(PATTERNS[k] for k in kinds)})" for c, kinds in _starts.items()) + ")"
#: Attempts after which a draw is lengthened.
PATIENCE = 6
#: Numbers that one draw of digits is good for; characters further on use them again.
DRAWS = 74


def kind_of(entity: Column) -> Column:
    cases = [(F.when, k) for k in PATTERNS]
    out = F.lit(None).cast("string")
    for _, k in reversed(cases):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(out)
    return out


def _list(words: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def _draw(hex_: Column, i: int | Column, n: int | Column) -> Column:
    """A number under n from the i-th six hex digits (there are DRAWS of them)."""
    start = F.lit(i * 6 + 1) if isinstance(i, int) else (i % DRAWS * 6 + 1).cast("int")
    return F.conv(F.substr(hex_, start, F.lit(6)), 16, 10).cast("int") % n


def _pick(words: list[str] | tuple[str, ...], hex_: Column, i: int) -> Column:
    return F.element_at(_list(words), _draw(hex_, i, len(words)) + 1)


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(text.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def atoms_of(entities: DataFrame) -> DataFrame:
    """From distinct (entity), also kind, and parts: (atom kind, atom, what stands in front of it) in order."""
    e = entities.withColumn("kind", kind_of(F.col("entity")))
    title = F.regexp_extract("entity", rf"^((?:{_titles})\.?\h)", 1)
    body = F.substr("entity", F.length(title) + 1)
    words = F.split(body, r"\h")
    known = {g: [n for (x, _), ns in GIVEN.items() if x == g for n in ns] for g in "mf"}
    bare = F.regexp_replace(title, r"[.\s\h]", "")
    by_title = F.when(bare.isin(*TITLES["m"]), "m").when(bare.isin(*TITLES["f"]), "f")
    first = F.element_at(words, 1)
    gender = F.coalesce(F.when(first.isin(*known["f"]), "f").when(first.isin(*known["m"]), "m"), by_title, F.when(F.crc32(first.cast("binary")) % 2 == 0, "f").otherwise("m"))
    part = lambda kind, atom, lead: F.struct(kind.alias("atom_kind"), atom.alias("atom"), lead.alias("lead"))
    # The last word is the family name, those before it are given names, each with the gender of the first unless known.
    of = lambda w: F.when(w.isin(*known["f"]), "given-f").when(w.isin(*known["m"]), "given-m").otherwise(F.concat(F.lit("given-"), gender))
    several = F.transform(words, lambda w, i: part(F.when(i == F.size(words) - 1, F.lit("family")).otherwise(of(w)), w, F.when(i == 0, title).otherwise(F.lit(" "))))
    # One word after a title is a family name unless it is a known given name.
    one = F.array(part(F.when(first.isin(*known["f"], *known["m"]), F.concat(F.lit("given-"), gender)).otherwise("family"), first, title))
    name = F.when(F.size(words) >= 2, several).otherwise(one)
    plain = F.array(part(F.col("kind"), F.when(F.col("kind") == "email", F.lower("entity")).otherwise(F.col("entity")), F.lit("")))
    return e.withColumn("parts", F.when(F.col("kind") == "name", name).otherwise(plain))


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check over an array of digits (the last one counts once)."""
    n = F.size(digits)
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, twice(d)).otherwise(d)), F.lit(0), lambda s, x: s + x)


def _mod97(iban: Column) -> Column:
    """Remainder of an IBAN's check: the first four signs go behind the others, letters count from 10."""
    bare = F.regexp_replace(iban, " ", "")
    signs = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")
    value = F.transform(signs, lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(value, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _iban(atom: Column, drawn: Column) -> Column:
    """The drawn number, with valid check digits if the atom's are."""
    blank = F.concat(F.substr(drawn, F.lit(1), F.lit(2)), F.lit("00"), F.substr(drawn, F.lit(5)))
    valid = F.concat(F.substr(drawn, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(blank)).cast("string"), 2, "0"), F.substr(drawn, F.lit(5)))
    return F.when(_mod97(atom) == 1, valid).otherwise(drawn)


def _masked(atom: Column, hex_: Column, fixed: Column) -> Column:
    """The atom with letters and digits drawn anew, in their script and case; characters before fixed stay."""

    def one(c: Column, i: Column) -> Column:
        pool = lambda s: F.substr(F.lit(s), _draw(hex_, i, len(s)) + 1, F.lit(1))
        return F.when(i < fixed, c).when(c.rlike(r"[0-9]"), pool("0123456789")).when(c.rlike(r"[a-z]"), pool("abcdefghijklmnopqrstuvwxyz")).when(c.rlike(r"[A-Z]"), pool("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(atom, ""), one), "")


def keyed(kind: Column, atom: Column, attempt: Column, key: str) -> Column:
    """Hex digits that the secret key, an atom and the attempt decide."""
    kind = F.when(kind.startswith("given"), "given").otherwise(kind)
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, atom, attempt.cast("string"), F.lit(str(k))), 256) for k in range(7)])


def surrogate(kind: Column, atom: Column, attempt: Column, h: Column) -> Column:
    """The draw of an atom (all of them columns), from its keyed() digits h."""
    more = F.floor(attempt / PATIENCE).cast("int")
    extra = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz" * 3), _draw(h, 72, 40) + 1, more)
    whole = F.lit(0)
    # Addresses keep their top-level domain.
    tld = F.regexp_extract(atom, r"(\.[A-Za-z0-9-]+)$", 1)
    email = F.concat(extra, _masked(F.substr(atom, F.lit(1), F.length(atom) - F.length(tld)), h, whole), tld)
    octet = lambda o, i: F.when((more > 0) | (F.length(o) == 3), F.when(more > 0, 1 + _draw(h, i, 254)).otherwise(100 + _draw(h, i, 155))).when(F.length(o) == 2, 10 + _draw(h, i, 90)).otherwise(1 + _draw(h, i, 9)).cast("string")
    ip = F.array_join(F.transform(F.split(atom, r"\."), octet), ".")
    phone = F.concat(_masked(atom, h, F.length(F.regexp_extract(atom, r"^(\+\d{1,3})(?=\D)", 1))), F.substr(F.lit("1234567890" * 3), _draw(h, 72, 10) + 1, more))
    first = F.lit(1)
    drawn = _masked(atom, h, first)
    digits = lambda c: F.transform(F.split(F.regexp_replace(c, r"\D", ""), ""), lambda x: x.cast("int"))
    valid = _luhn_sum(digits(atom)) % 10 == 0
    rest = _luhn_sum(F.concat(F.slice(digits(drawn), F.lit(1), F.size(digits(drawn)) - 1), F.array(F.lit(0)))) % 10
    check = (10 - rest) % 10
    last = F.when(valid, check).otherwise((check + 1 + _draw(h, 73, 9)) % 10)
    card = F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), last.cast("string"))
    # No area of a drawn number is one that is never given out.
    ssn = F.concat(F.lpad((1 + _draw(h, 0, 665)).cast("string"), 3, "0"), F.lit("-"), F.lpad((1 + _draw(h, 1, 99)).cast("string"), 2, "0"), F.lit("-"), F.lpad((1 + _draw(h, 2, 9999)).cast("string"), 4, "0"))
    iban = _iban(atom, _masked(atom, h, F.lit(2)))
    hexa = lambda c, i: F.when(c.rlike(r"[0-9]"), F.substr(F.lit("0123456789"), _draw(h, i, 10) + 1, F.lit(1))).when(c.rlike("[a-f]"), F.substr(F.lit("abcdef"), _draw(h, i, 6) + 1, F.lit(1))).otherwise(F.substr(F.lit("ABCDEF"), _draw(h, i, 6) + 1, F.lit(1)))
    secret = F.array_join(F.transform(F.split(atom, ""), hexa), "")
    script = _script(atom)
    given = F.lit(None).cast("string")
    for (g, s), names in GIVEN.items():
        given = F.when((kind == f"given-{g}") & (script == s), F.concat(_pick(names, h, 0), *[F.when(attempt > PATIENCE * k, F.concat(F.lit("-"), _pick(names, h, k))).otherwise("") for k in range(1, 5)])).otherwise(given)
    family = F.lit(None).cast("string")
    for s, (heads, ends) in FAMILY.items():
        made = F.concat(_pick(heads, h, 0), *[F.when(attempt > 2 * k, F.lower(_pick(heads, h, k + 1))).otherwise("") for k in range(3)], _pick(ends, h, 5))
        family = F.when(script == s, made).otherwise(family)
    kinds = {"email": email, "ip": ip, "phone": phone, "card": card, "ssn": ssn, "iban": iban, "secret": secret, "family": family}
    return reduce(lambda out, k: F.when(kind == k, kinds[k]).otherwise(out), kinds, given)


def assign(atoms: DataFrame, key: str = KEY) -> DataFrame:
    """From distinct (atom_kind, atom), also surrogate: different for different atoms of a kind, none of them an atom."""
    space = F.when(F.col("atom_kind").startswith("given"), "given").otherwise(F.col("atom_kind"))
    hexes = keyed(F.col("atom_kind"), F.col("atom"), F.col("attempt"), key)
    left = cut(atoms.withColumn("attempt", F.lit(0)).withColumn("space", space).withColumn("h", hexes))
    real = left.select("space", F.col("atom").alias("surrogate")).distinct()
    done = None
    while True:
        drawn = left.withColumn("surrogate", surrogate(F.col("atom_kind"), F.col("atom"), F.col("attempt"), F.col("h")))
        # Of equal draws one wins; a group of equal draws is counted by its least hash, which is aggregated partially.
        order = F.struct(F.xxhash64("atom_kind", "atom").alias("x"), F.col("atom").alias("a"), F.col("atom_kind").alias("k"))
        winner = drawn.groupBy("space", "surrogate").agg(F.min(order).alias("w"))
        winner = winner.join(real, ["space", "surrogate"], "left_anti")
        if done is not None:
            winner = winner.join(done.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = winner.select("space", F.col("w.k").alias("atom_kind"), F.col("w.a").alias("atom"), "surrogate")
        won = cut(won)
        done = won if done is None else cut(done.unionByName(won))
        left = cut(left.join(won.select("atom_kind", "atom"), ["atom_kind", "atom"], "left_anti").withColumn("attempt", F.col("attempt") + 1).withColumn("h", hexes))
        if left.isEmpty():
            return done.select("atom_kind", "atom", "surrogate")


def detected(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), 0)


def mapping(entities: DataFrame, key: str = KEY) -> DataFrame:
    """From distinct (entity): entity, kind, replacement."""
    e = cut(atoms_of(entities))
    parts = e.select("entity", "kind", F.posexplode("parts").alias("i", "p")).select("entity", "kind", "i", "p.*")
    chosen = assign(parts.select("atom_kind", "atom").distinct(), key)
    put = parts.join(chosen, ["atom_kind", "atom"])
    upper = (F.col("entity") == F.upper("entity")) & (F.col("kind") == "email")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat("lead", "surrogate").alias("s")))), lambda x: x["s"]), "")
    out = put.groupBy("entity", "kind").agg(words.alias("replacement"))
    return out.withColumn("replacement", F.when(upper, F.upper("replacement")).otherwise(F.col("replacement")))


def replace_entities(docs: DataFrame, key: str = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, text with surrogates, and n_entities (with underscores behind it where docs has that). Texts are
    searched once: rows are written aside with what was found in them, and only those with entities are joined."""
    columns, count = docs.columns, free(["n_entities"], docs.columns)[0]
    ents, th = "_stratamap_ents", "_stratamap_th"
    found, _ = stored(docs.withColumn(ents, F.coalesce(detected(F.col(text)), F.array().cast("array<string>"))), "entities", "zstd")
    some = found.filter(F.size(ents) > 0).withColumn(th, F.md5(F.concat_ws("\x1f", ents)))
    # Rows that hold the same entities in the same order share what stands for them.
    each = some.select(th, F.posexplode(ents).alias("i", "entity")).dropDuplicates([th, "i"])
    chosen = mapping(each.select("entity").distinct(), key)
    puts = each.join(chosen, "entity").groupBy(th).agg(F.array_sort(F.collect_list(F.struct("i", "replacement"))).alias("_stratamap_put"))
    pairs = F.zip_with(F.slice(F.split(F.col(text), PATTERN, -1), F.lit(1), F.size(ents)), "_stratamap_put", lambda a, b: F.concat(a, b["replacement"]))
    new = F.concat(F.array_join(pairs, ""), F.element_at(F.split(F.col(text), PATTERN, -1), -1))
    changed = some.join(puts, th).withColumn("_stratamap_new", new)
    changed = changed.select(*[F.col("_stratamap_new").alias(c) if c == text else F.col(f"`{c}`") for c in columns], F.size(ents).cast("int").alias(count))
    same = found.filter(F.size(ents) == 0).drop(ents).withColumn(count, F.lit(0))
    return same.unionByName(changed)


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, under the key that the session names in KEY_SETTING."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, KEY))
