"""Surrogates for personal data: keyed, of the same type, gender, script and format, distinct and coreferent.

Only DataFrame functions are used. One search marks every entity with the number of the alternative that found it. A
name is taken apart into given names, which have the gender of the form of address before it, and family names; the
words of a name are replaced wherever they stand in the same text. So an entity is an address, a number, a secret, a
given name or a family name.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Work, tasks_for
from tessera.llm.decontaminate import with_value

KEY = "tessera-surrogates-1"
#: Up to so many colliding entities go into the plan as constants; beyond that they are joined. The result is the same.
MOST_CONSTANTS = 1000
#: Surrogates are drawn so many times again; from then on an attempt is a number that the surrogate itself holds.
MOST_ATTEMPTS = 16
#: Numbers are given out so many times; they double each time, so more would mean a space without an end of taken ones.
MOST_NUMBERINGS = 24
#: Entities whose canonical form is longer stand in tables by its digest.
LONG = 128

# How the entities look.
BLANK, SPACE, GAP = "[ \u00a0\\t\\n]", "[ \u00a0]", "[ \u00a0\\t\\n]{1,2}"
PARTICLES = "von|van|de|der|den|di|da|du|la|le|del|dos|zu|af"
INITIALS = r"(?:\p{Lu}\.)++"
#: A capital and more letters; apostrophes and hyphens before at least two letters belong to it.
WORD = r"\p{Lu}(?:[\p{L}\p{M}]|['’\-](?=\p{L}{2}))++"
NAME = rf"(?:(?:{PARTICLES}){SPACE}){{0,2}}(?:{INITIALS}{SPACE}?){{0,2}}{WORD}(?:{SPACE}(?:{INITIALS}{SPACE}?){{0,2}}(?:(?:{PARTICLES}){SPACE}){{0,2}}{WORD}){{0,2}}"
MEN, WOMEN = "Mr|Mr\\.|Herr|Herrn|Monsieur|Señor|Sr\\.|Don|Господин|господин|г-н", "Mrs|Mrs\\.|Ms|Ms\\.|Miss|Frau|Madame|Mme|Señora|Sra\\.|Doña|Госпожа|госпожа|г-жа"
SECRET = r"[A-Za-z0-9_\-+/.]"
#: Each alternative with its kind. It begins with a cheap look at one or two characters, so that most places are passed
#: at once: what begins a run of letters or digits (or follows another entity), what follows a sign of assignment, what
#: begins with a digit, "+" or "(", and a capital after white space.
ALTERNATIVES: list[tuple[str, str]] = [
    ("email", r"(?:(?<![\p{L}\p{N}])|\G)(?=[\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,255}+@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"),
    ("hex", r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"),
    ("secret", rf"(?<=[=:][ \x22']{{0,4}})(?={SECRET})(?<=(?i:token|secret|password|passwd|apikey|api_key|access_key) {{0,3}}[=:] {{0,3}}[\x22']?){SECRET}{{8,}}(?<![.])"),
    ("iban", r"(?<![0-9A-Za-z])(?=[A-Z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?=[0-9A-Fa-f])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ip", r"(?=[0-9])(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"),
    ("ssn", r"(?=[0-9])(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    ("phone", r"(?=[0-9+(])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9]))"),
    ("card", r"(?=[0-9])(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"),
    ("woman", rf"(?<={BLANK})(?=\p{{Lu}}|(?:{PARTICLES}){SPACE})(?<=(?<!\p{{L}})(?:{WOMEN}){GAP}){NAME}"),
    ("man", rf"(?<={BLANK})(?=\p{{Lu}}|(?:{PARTICLES}){SPACE})(?<=(?<!\p{{L}})(?:{MEN}){GAP}){NAME}"),
]
KINDS = [kind for kind, _ in ALTERNATIVES]
ANY = "|".join(f"({pattern})" for _, pattern in ALTERNATIVES)
#: What every text with an entity has.
MAYBE = rf"[0-9@]|[=:][ \x22']{{0,4}}{SECRET}|(?<!\p{{L}})(?:{MEN}|{WOMEN})[  \t\n]|[A-Fa-f]{{32}}"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
SYLLABLES = {"latin": "ba de fi go lu ma ne pi ro su ta ve wi zo ka len".split(), "cyrillic": "ба де фи го лу ма не пи ро су та ве ви зо ка лен".split()}
LETTERS = {"IsCyrillic": "абвгдежзиклмнопрстуфхцчшыэюя", "IsGreek": "αβγδεζηθικλμνξοπρστυφχψω", "L": "abcdefghijklmnopqrstuvwxyz"}
# Noncharacters. MARK stands around each entity, GROUP before and after the matches of its alternatives;
# where a text has one of them itself, ESCAPE and another stand for it.
MARK, GROUP, ESCAPE = "\ufdd0", "\ufdd2", "\ufdd3"
INSTEAD = {MARK: "\ufdd4", GROUP: "\ufdd5", ESCAPE: "\ufdd6"}


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def _canonical(kind: Column, match: Column) -> Column:
    """What is the same for all ways to write an entity; for long ones, its digest."""
    low = F.lower(match)
    same = (
        F.when(kind == "secret", match).when(kind == "phone", F.regexp_replace(match, r"[^0-9+]", "")).when(kind.isin("card", "iban", "ssn"), _bare(low))
        .when((kind == "family") & low.rlike(r"\p{IsCyrillic}(?:ов|ев|ин)а$"), F.regexp_replace(low, "а$", "")).otherwise(low)
    )
    return with_value(same, lambda c: F.when(F.length(c) > LONG, F.sha2(c, 256)).otherwise(c))


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    """A number below n out of the keyed seed, for place i."""
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def _pick(values: list[str] | str, at: Column) -> Column:
    return F.substring(F.lit(values), at + 1, F.lit(1)) if isinstance(values, str) else F.get(F.array(*map(F.lit, values)), at)


def _other(c: Column, seed: Column, i: Column, hexes: Column) -> Column:
    """A digit for a digit, a letter for a letter of the same case and script; other characters stay."""
    letter = F.when(hexes, _pick("abcdef", _draw(seed, i, 6)))
    for script, letters in LETTERS.items():
        letter = letter.when(c.rlike(rf"\p{{{script}}}"), _pick(letters, _draw(seed, i, len(letters))))
    return F.when(c.rlike(r"\p{N}"), _pick("0123456789", _draw(seed, i, 10))).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)


def _like(text: Column, seed: Column, hexes: Column) -> Column:
    """Character by character, each by its place."""
    return F.array_join(F.transform(_chars(text), lambda c, i: _other(c, seed, i, hexes)), "")


def _spread(text: Column, seed: Column, first: Column) -> Column:
    """As `_like`, by the place among letters and digits, so that separators make no difference; the first so many stay.
    For texts of bounded length."""
    def one(c: Column, i: Column) -> Column:
        n = F.length(_bare(F.substring(text, F.lit(1), i + 1)))
        return F.when(n <= first, c).otherwise(_other(c, seed, n, F.lit(False)))

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a text of digits."""
    parts = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10


def _card(match: Column, seed: Column, number: Column) -> Column:
    """The first digit and separators stay; a valid check digit stays valid."""
    made = F.concat(_spread(match, seed, F.lit(1)), F.when(number != "", F.concat(number, F.lit("0"))).otherwise(F.lit("")))

    def fixed(made: Column) -> Column:
        head = F.substring(made, F.lit(1), F.length(made) - 1)
        return F.concat(head, F.pmod(F.lit(10) - _luhn(F.concat(_bare(head), F.lit("0"))), F.lit(10)).cast("string"))

    return with_value(made, lambda m: F.when(_luhn(_bare(match)) == 0, fixed(m)).otherwise(m))


def _mod97(text: Column) -> Column:
    """An IBAN's remainder: the first four characters go to the end, letters count from 10 on."""
    turned = F.upper(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4)))
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(match: Column, seed: Column, number: Column) -> Column:
    """The country and separators stay; valid check digits stay valid."""
    def fixed(made: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(F.substring(made, 1, 2), F.lit("00"), _bare(F.substring(made, F.lit(5), F.length(made)))))
        return F.concat(F.substring(made, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(made, F.lit(5), F.length(made)))

    return with_value(F.concat(_spread(match, seed, F.lit(2)), number), lambda m: F.when(_mod97(_bare(match)) == 1, fixed(m)).otherwise(m))


def _ip(match: Column, seed: Column, attempt: Column) -> Column:
    def octet(p: Column, i: Column) -> Column:
        return F.when(F.length(p) == 1, _draw(seed, i, 9) + 1).when(F.length(p) == 2, _draw(seed, i, 90) + 10).otherwise(_draw(seed, i, 155) + 100).cast("string")

    drawn = F.when(match.contains(":"), _like(match, seed, F.lit(True))).otherwise(F.array_join(F.transform(F.split(match, r"\."), octet), "."))
    n = attempt.cast("long") - MOST_ATTEMPTS - 1
    octets = F.concat_ws(".", *[(F.floor(n / F.lit(156**i)) % 156 + 100).cast("string") for i in (3, 2, 1, 0)])
    groups = F.lower(F.lpad(F.hex(n), 8, "0"))
    numbered = F.when(match.contains(":"), F.concat_ws(":", F.lit("2001:db8:0:0:0:0"), F.substring(groups, 1, 4), F.substring(groups, 5, 4))).otherwise(octets)
    return F.when(attempt > MOST_ATTEMPTS, numbered).otherwise(drawn)


def _email(match: Column, seed: Column, number: Column, key: str) -> Column:
    """Local part in the same format; domains go, coreferent among themselves, to names below reserved domains."""
    local, domain = F.substring_index(match, "@", 1), F.lower(F.substring_index(match, "@", -1))
    top = F.substring_index(domain, ".", -1)
    made = F.concat(_like(local, seed, F.lit(False)), number, F.lit("@m"), F.substring(F.sha2(F.concat(F.lit(key + "|domain|"), domain), 256), 1, 12), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise(F.lit("com")))
    return F.when(F.upper(match) == match, F.upper(made)).otherwise(made)


def _name(kind: Column, match: Column, seed: Column, attempt: Column, number: Column) -> Column:
    """Syllables, one more with each attempt; given names end by gender, Cyrillic family names by the ending."""
    def by_script(script: str, ends: dict[str, str]) -> Column:
        n = F.when(kind == "family", 4).otherwise(3) + F.least(attempt, F.lit(MOST_ATTEMPTS)).cast("int")
        drawn = F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES[script], _draw(seed, i, 16)))
        counted = F.transform(_chars(number), lambda c: _pick(SYLLABLES[script], c.cast("int")))
        end = F.when(kind == "given woman", ends["woman"]).when(kind == "given man", ends["man"]).when(match.rlike("(?i)а$"), ends["her"]).otherwise(ends["his"])
        return F.concat(F.initcap(F.concat(F.array_join(drawn, ""), F.array_join(counted, ""))), end)

    made = F.when(match.rlike(r"\p{IsCyrillic}"), by_script("cyrillic", {"woman": "на", "man": "н", "her": "ова", "his": "ов"})).otherwise(by_script("latin", {"woman": "na", "man": "n", "her": "", "his": ""}))
    made = F.concat(F.regexp_extract(match, r"^\p{L}{1,2}['’]", 0), made)
    return F.when(F.upper(match) == match, F.upper(made)).otherwise(made)


def surrogate(kind: Column, match: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement for one way of writing an entity; the same for all documents and, but for form, all ways."""
    number = F.when(attempt > MOST_ATTEMPTS, F.lpad(attempt.cast("string"), 14, "0")).otherwise(F.lit(""))

    def made(seed: Column) -> Column:
        return (
            F.when(kind == "email", _email(match, seed, number, key)).when(kind == "ip", _ip(match, seed, attempt)).when(kind == "card", _card(match, seed, number))
            .when(kind.isin("family", "given man", "given woman"), _name(kind, match, seed, attempt, number)).when(kind.isin("hex", "secret"), F.concat(_like(match, seed, kind == "hex"), number))
            .when(kind == "phone", F.concat(_spread(match, seed, F.length(_bare(F.regexp_extract(F.regexp_replace(match, "[^0-9+]", ""), COUNTRY, 0)))), number))
            .when(kind == "iban", _iban(match, seed, number)).when(kind == "ssn", F.concat(_spread(match, seed, F.lit(0)), number)).when(kind == "initials", _like(match, seed, F.lit(False))).otherwise(match)
        )

    return with_value(F.sha2(F.concat(F.lit(key + "|"), kind, F.lit("|"), attempt.cast("string"), F.lit("|"), _canonical(kind, match)), 512), made)


def _units(kind: Column, match: Column) -> Column:
    """(kind, match, tail) of what is replaced by itself: the words of a name, each with the separator after it, or all."""
    def words(part: Column, last: Column) -> Column:
        def one(w: Column) -> Column:
            bare = F.regexp_replace(w, "[ \u00a0\\-]+$", "")
            of = F.when(bare.rlike(rf"^{INITIALS}$"), F.lit("initials")).when(bare.rlike(rf"^(?:{PARTICLES})$"), F.lit("particle")).when(last, F.lit("family")).otherwise(F.concat(F.lit("given "), kind))
            return F.struct(of.alias("kind"), bare.alias("match"), F.substring(w, F.length(bare) + 1, F.length(w)).alias("tail"))

        return F.transform(F.split(part, r"(?<=-)"), one)

    parts = F.split(match, f"(?<={SPACE})")
    name = with_value(parts, lambda p: F.flatten(F.transform(p, lambda x, i: words(x, i == F.size(p) - 1))))
    other = F.array(F.struct(F.when(kind == "ipv6", F.lit("ip")).otherwise(kind).alias("kind"), match.alias("match"), F.lit("").alias("tail")))
    return F.when(kind.isin("woman", "man"), name).otherwise(other)


def _record(kind: str, match: str) -> str:
    """What stands for an entity in a marked text: its match in its kind's group."""
    return MARK + "".join(GROUP + (match if k == kind else "") for k in [*KINDS, "mention"]) + GROUP + MARK


def _computed(df: DataFrame, column: Column, name: str) -> DataFrame:
    """df with a column that is computed once, out of a generator."""
    return df.select("*", F.explode_outer(F.array(column)).alias(name))


def _found(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`kept` (the columns `keep` as a struct), `text`, and where something is found: `pieces`, the text between entities,
    and `found` (kind, units) of each entity."""
    odd = "[" + "".join(INSTEAD) + "]"
    t = F.col("text")
    escaped = t
    for c in (ESCAPE, MARK, GROUP):
        escaped = F.replace(escaped, F.lit(c), F.lit(ESCAPE + INSTEAD[c]))
    # one struct in any case, so that the columns `keep` may have any names
    df = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(text).alias("text"))
    every = MARK + "".join(f"{GROUP}${i + 1}" for i in range(len(KINDS))) + GROUP + GROUP + MARK
    df = _computed(df, F.when(t.rlike(MAYBE), F.regexp_replace(F.when(t.rlike(odd), escaped).otherwise(t), ANY, every)), "marked")
    kinds = F.array(*map(F.lit, [*KINDS, "mention"]))

    def record(r: Column) -> Column:
        """Kind and match: as many groups stand before the match as its kind's place."""
        return F.struct(F.get(kinds, F.length(r) - F.length(F.ltrim(r, F.lit(GROUP))) - 1).alias("kind"), F.btrim(r, F.lit(GROUP)).alias("match"))

    def parsed(marked: str) -> Column:
        units = lambda x: F.struct(x["kind"].alias("kind"), _units(x["kind"], x["match"]).alias("units"))
        records = F.filter(F.split(F.col(marked), MARK), lambda _, i: i % 2 == 1)
        return F.transform(F.transform(records, record), units)

    df = _computed(df, F.when(F.col("marked").contains(MARK), parsed("marked")), "first")
    # the words of the text's names, wherever they stand between entities
    units = F.flatten(F.transform(F.filter("first", lambda x: x["kind"].isin("woman", "man")), lambda x: x["units"]))
    names = F.filter(F.array_distinct(F.transform(units, lambda u: F.struct(u["match"].alias("match"), u["kind"].alias("kind")))), lambda u: u["kind"].isin("family", "given man", "given woman"))
    df = _computed(df, F.when(F.size("first") > 0, names), "names")
    mention = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}'’])("), F.array_join(F.reverse(F.sort_array(F.array_distinct(F.transform("names", lambda u: u["match"])))), "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    again = with_value(mention, lambda m: F.array_join(F.transform(F.split("marked", MARK), lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, m, F.lit(_record("mention", "$1")))).otherwise(p)), MARK))
    df = _computed(df, F.when(F.size("names") > 0, again).otherwise(F.col("marked")), "all")

    def named(x: Column) -> Column:
        """A mention has the kind of the first name with that word."""
        known = lambda u: F.struct(F.get(F.filter("names", lambda n: n["match"] == u["match"]), F.lit(0))["kind"].alias("kind"), u["match"].alias("match"), u["tail"].alias("tail"))
        return F.when(x["kind"] == "mention", F.struct(F.lit("name").alias("kind"), F.transform(x["units"], known).alias("units"))).otherwise(x)

    found = F.when(F.size("names") > 0, F.transform(parsed("all"), named)).otherwise(F.col("first"))
    pieces = F.filter(F.split("all", MARK), lambda _, i: i % 2 == 0)
    plain = lambda p: F.replace(F.replace(F.replace(p, F.lit(ESCAPE + INSTEAD[GROUP]), F.lit(GROUP)), F.lit(ESCAPE + INSTEAD[MARK]), F.lit(MARK)), F.lit(ESCAPE + INSTEAD[ESCAPE]), F.lit(ESCAPE))
    pieces = F.when(t.rlike(odd), F.transform(pieces, plain)).otherwise(pieces)
    return df.select("kept", "text", F.when(F.size("first") > 0, pieces).alias("pieces"), F.when(F.size("first") > 0, found).alias("found"))


def _collisions(work: Work, docs: DataFrame, key: str) -> DataFrame:
    """kind, canonical, attempt of the entities whose first surrogate is another's or is itself in the corpus.

    Of entities with one surrogate the first in order keeps it; the others try again with the next attempt, and are
    checked against all that are settled. Those that MOST_ATTEMPTS draws don't settle are numbered, and their surrogates
    made longer by the number, so that they differ from each other. What still meets a surrogate or an entity of the
    corpus takes numbers beyond the double of all before, so that any stretch of taken ones is soon passed.
    """
    each = _found(docs, []).select(F.explode_outer(F.flatten(F.transform("found", lambda x: x["units"]))).alias("x")).filter("x.kind not in ('initials', 'particle')")
    each = each.select("x.kind", "x.match", _canonical(F.col("x.kind"), F.col("x.match")).alias("canonical"))
    each = work.write(each.groupBy("kind", "canonical").agg(F.min("match").alias("match")), "entities")
    real = each.select("kind", F.col("canonical").alias("made"))
    state, attempt, number = each.withColumn("attempt", F.lit(0).cast("long")), 0, MOST_ATTEMPTS + 1
    while True:
        made = _computed(state, surrogate(F.col("kind"), F.col("match"), F.col("attempt"), key), "m").withColumn("made", _canonical(F.col("kind"), F.col("m"))).drop("m")
        made = made.join(real.withColumn("taken", F.lit(True)), ["kind", "made"], "left")
        first = made.filter("taken is null").groupBy("kind", "made").agg(F.min(F.struct("attempt", "canonical")).alias("first"))
        bad = made.join(first, ["kind", "made"], "left").select("kind", "canonical", "match", "attempt", F.coalesce(F.struct("attempt", "canonical") != F.col("first"), F.lit(True)).alias("again"))
        bad = work.write(bad, f"round{attempt}")
        work.drop(f"round{attempt - 1}")
        left = bad.filter("again").count()
        if not left:
            return bad.filter("attempt > 0").select("kind", "canonical", "attempt")
        attempt += 1
        if attempt <= MOST_ATTEMPTS:
            state = bad.select("kind", "canonical", "match", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
        elif attempt > MOST_ATTEMPTS + MOST_NUMBERINGS:
            raise ValueError(f"{left} entities find no surrogate of their own")
        else:
            numbers = _numbered(work, bad.filter("again").select("kind", "canonical"), f"numbers{attempt}")
            state = bad.join(numbers, ["kind", "canonical"], "left").select("kind", "canonical", "match", F.coalesce(F.col("number") + number, F.col("attempt")).alias("attempt"))
            number = 2 * (number + left)


def _numbered(work: Work, rows: DataFrame, name: str) -> DataFrame:
    """rows with `number`, from 0 in the order of kind and canonical; only the sizes of partitions are put together."""
    order = ["kind", "canonical"]
    rows = rows.repartitionByRange(tasks_for(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    rows = work.write(rows, name).withColumns({"part": F.shiftright("id", 33), "at": F.col("id").bitwiseAND((1 << 33) - 1)})
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    before = dict(zip([p for p, _ in sizes], itertools.accumulate([0, *[n for _, n in sizes]])))
    table = F.create_map(*[F.lit(v).cast("long") for kv in before.items() for v in kv])
    return rows.select(*order, (F.col("at") + F.element_at(table, F.col("part"))).alias("number"))


def replace(docs: DataFrame, keep: list[str], key: str = KEY, most_constants: int = MOST_CONSTANTS) -> DataFrame:
    """The columns `keep`, `text` with surrogates for all entities, `n_entities` and `kinds` (their types in order).

    Found are emails (of up to 256 characters before the @), secrets, IBANs, IP addresses, social security numbers,
    phones, cards, names after a form of address, which gives their gender, and in the same text the words of these
    names wherever they stand as whole words with the same letters (kind `name`). Equal entities get equal surrogates
    everywhere, whatever their case or separators (a secret is another in another case); different ones of a type get
    different ones, none of which occurs in the corpus, checked over all documents. Initials are replaced without that
    check, and particles of names (von, de) stay. A null text stays null with no entities, an empty text stays empty.
    The time for a text grows with its length. Repeated rows are treated alike. An empty table gives no rows. A kept
    column named like one of the results is replaced; other columns may have any names.
    """
    keep = [c for c in keep if c not in ("text", "n_entities", "kinds")]
    work = Work(docs.sparkSession, "pii")
    special = work.write(_collisions(work, docs, key), "special")
    count = special.count()
    zero = F.lit(0).cast("long")
    attempt: Callable[[Column, Column], Column]
    name = lambda kind, match: F.concat(kind, F.lit("|"), _canonical(kind, match))
    if not count:
        df, attempt = _found(docs, keep), lambda kind, match: zero
    elif count <= most_constants:
        table = F.create_map(*[v for r in special.collect() for v in (F.lit(f"{r['kind']}|{r['canonical']}"), F.lit(r["attempt"]).cast("long"))])
        df, attempt = _found(docs, keep), lambda kind, match: F.coalesce(F.element_at(table, name(kind, match)), zero)
    else:
        two = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]  # texts are told apart by 128 bits
        each = _found(docs.select(*two, "text"), ["k1", "k2"]).select("kept.k1", "kept.k2", F.explode_outer(F.flatten(F.transform("found", lambda x: x["units"]))).alias("x")).filter("x is not null")
        each = each.select("k1", "k2", "x.kind", _canonical(F.col("x.kind"), F.col("x.match")).alias("canonical")).distinct().join(special, ["kind", "canonical"])
        per = work.write(each.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "canonical"), "attempt"))).alias("a")), "attempts")  # entities of one text
        with_attempts = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept"), "text", *two).join(per, ["k1", "k2"], "left")
        df = _found(with_attempts, ["kept", "a"]).select("kept.kept", "kept.a", "text", "pieces", "found")
        attempt = lambda kind, match: F.coalesce(F.element_at(F.col("a"), name(kind, match)), zero)

    def unit(u: Column) -> Column:
        return F.concat(surrogate(u["kind"], u["match"], attempt(u["kind"], u["match"]), key), u["tail"])

    made = F.transform("found", lambda x: F.array_join(F.transform(x["units"], unit), ""))
    text = F.array_join(F.zip_with("pieces", made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.transform("found", lambda x: F.when(x["kind"] == "hex", F.lit("secret")).when(x["kind"] == "ipv6", F.lit("ip")).otherwise(x["kind"]))
    out = [F.col("kept").getField(c).alias(c) for c in keep]
    return df.select(*out, F.when(F.col("found").isNull(), F.col("text")).otherwise(text).alias("text"), F.when(F.col("found").isNull(), F.lit(0)).otherwise(F.size("found")).alias("n_entities"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
