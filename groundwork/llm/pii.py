"""Keyed, type-consistent surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern and rewritten in their row. A surrogate is a keyed Feistel permutation of the
entity: the halves of its characters shift each other, by digests of the key, within their own class (vowels,
consonants, digits, by case and script). The permutation is a bijection on every format, so two entities of a kind
never share a surrogate and one entity has the same surrogate in every text, without a table of entities, a join or a
hot key. Every text's entities are checked for it (`n_collisions`), and `collisions` checks it over a corpus. Case does
not change the shifts, so variants of one entity stay variants of one surrogate; phone numbers are permuted on their
last ten digits, whatever their punctuation; card numbers keep their first digit and their check digit's error;
addresses keep octets below 256; given names of the lists move within the list of their gender and script. Other names
keep their pattern of vowels and consonants; one that would come out as a listed name or a title is permuted again, so
listed and other names never meet. Names are detected by a title or a listed given name; what is detected once in a
text is replaced there also where it stands alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}-])[\p{L}\p{N}.-]*\.\p{L}{2,}"
IPV4 = r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
PHONE = r"(?<!\d)(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = (
    r"(?<![\p{L}\d._-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\p{L}\d_])"
)
_WORD = r"\p{Lu}[\p{L}'’-]*\p{Ll}"
#: Titles that announce a name, and given names by gender and script.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Господин", "Госпожа", "Κύριος", "Κυρία"]
GIVEN = {
    "female latin": ["Alice", "Barbara", "Clara", "Diana", "Emma", "Fiona", "Grace", "Hannah", "Isabel", "Julia", "Laura", "Maria", "Nora", "Olivia", "Rachel", "Sophie"],
    "male latin": ["Adam", "Brian", "Carlos", "Daniel", "Edward", "Frank", "George", "Henry", "Jacob", "Kevin", "Lucas", "Martin", "Oscar", "Peter", "Robert", "Thomas"],
    "female cyrillic": ["Анна", "Вера", "Ирина", "Мария", "Ольга", "Татьяна"],
    "male cyrillic": ["Алексей", "Борис", "Дмитрий", "Иван", "Николай", "Сергей"],
}
NAME = (
    rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.?\x20{_WORD}(?:\x20{_WORD})?"
    rf"|(?:{'|'.join(n for names in GIVEN.values() for n in names)})\x20{_WORD})(?!\p{{L}})"
)
KINDS = {"email": EMAIL, "ipv4": IPV4, "card": CARD, "phone": PHONE, "ssn": SSN, "name": NAME}
#: All kinds; one look ahead spares most characters the kinds that begin with a digit or a capital.
ANY = rf"{EMAIL}|(?=[\d(+])(?:{IPV4}|{CARD}|{PHONE}|{SSN})|{NAME}"
#: What any text with an entity holds.
HINT = rf"@|\d{{3}}|\d\.\d|\+\d|{NAME}"
#: Classes of characters that are permuted among themselves; every lower-case letter of a class has one upper case, or
#: none of the class has.
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "āăąēĕėęěĩīĭįōŏőœũūŭůűų",
    "çñćĉċčďđĝğġģĥħĵķĺļľłńņňŕŗřśŝşšţťŵźżžðþ", "ßĸ", "аеёиоуыэюяіїє", "бвгджзйклмнпрстфхцчшщьъґўђѓјљњћќџѕ",
    "αεηιουωάέήίόύώϊϋ", "βγδζθκλμνξπρστφχψ",
]
#: First and last letters of scripts without case, each permuted within itself.
RANGES = [(0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x915, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
#: The key of tests and of sessions that set none. Replaced texts are only as private as their key.
DEMONSTRATION_KEY = "groundwork"


def session_key(spark: SparkSession) -> str:
    """The session's key, spark.groundwork.pii.key, or the demonstration key."""
    return spark.conf.get("spark.groundwork.pii.key", None) or DEMONSTRATION_KEY


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chars(s: str) -> str:
    return f"regexp_extract_all({s}, '(?s).', 0)"


def _shift(s: str, digest: str) -> str:
    """SQL: each character of s moved within its class by the digest's bytes; case is kept."""
    classes = "array(" + ", ".join(f"'{k}'" for k in CLASSES) + ")"
    step = "cast(conv(substr(d, 1 + (2 * j) % 62, 2), 16, 10) as int)"
    wide = "cast(conv(substr(d, 1 + (2 * j) % 60, 4), 16, 10) as int)"
    ranges = " ".join(f"when ascii(c) between {a} and {b} then decode(unhex(lpad(hex({a} + (ascii(c) - {a} + {wide}) % {b - a + 1}), 4, '0')), 'UTF-16BE')" for a, b in RANGES)
    low = f"coalesce(get(transform(filter({classes}, k -> instr(k, lower(c)) > 0), k -> substr(k, 1 + (instr(k, lower(c)) - 1 + {step}) % length(k), 1)), 0), case {ranges} else c end)"
    new = f"transform(array({low}), x -> case when c = lower(c) then x else upper(x) end)[0]"
    return f"transform(array({digest}), d -> array_join(transform({_chars(s)}, (c, j) -> {new}), ''))[0]"


def permuted(s: str, key: str, kind: str, rounds: int = 4) -> str:
    """SQL for the Feistel permutation of the string s (an even number of rounds, so halves end in place).

    The digests see lower case only.
    """
    half = f"cast(length({s}) / 2 as int)"
    digest = f"sha2(cast(concat({_q(f'{key}|{kind}|')}, i, '|', length({s}), '|', lower(p.r)) as binary), 256)"
    return (
        f"aggregate(sequence(0, {rounds - 1}), struct(substr({s}, 1, {half}) as l, substr({s}, 1 + {half}) as r), "
        f"(p, i) -> struct(p.r as l, {_shift('p.l', digest)} as r), p -> concat(p.l, p.r))"
    )


def _put_digits(m: str, digits: str) -> str:
    """SQL: the digits of m, from the left, replaced by those of `digits`; the rest of m stays."""
    return (
        f"aggregate({_chars(m)}, struct(0 as n, '' as out), (a, c) -> case when c rlike '[0-9]' "
        f"then struct(a.n + 1 as n, concat(a.out, substr({digits}, a.n + 1, 1)) as out) else struct(a.n as n, concat(a.out, c) as out) end, a -> a.out)"
    )


def _luhn(digits: str) -> str:
    """SQL: the check digit that digits (without it) ask for."""
    return (
        f"(10 - aggregate(transform(reverse({_chars(digits)}), (c, i) -> case when i % 2 = 1 then int(c) "
        f"when 2 * int(c) > 9 then 2 * int(c) - 9 else 2 * int(c) end), 0, (a, x) -> a + x) % 10) % 10"
    )


def name_word(w: str, key: str) -> str:
    """SQL for the surrogate of one word of a name: listed names within their list, others outside of all lists."""
    array = lambda names: f"array({', '.join(map(_q, names))})"
    lists = " ".join(
        f"when array_contains({array(names)}, {w}) then {array(names)}"
        f"[cast((array_position({array(names)}, {w}) + conv(substr(sha2(cast({_q(f'{key}|{which}')} as binary), 256), 1, 4), 16, 10)) % {len(names)} as int)]"
        for which, names in GIVEN.items()
    )
    taken = array([*TITLES, *(n for names in GIVEN.values() for n in names)])
    walk = f"aggregate(sequence(0, 7), {w}, (v, t) -> case when t = 0 or array_contains({taken}, v) then {permuted('v', key, 'name')} else v end)"
    return f"case when rtrim('.', {w}) in ({', '.join(map(_q, TITLES))}) then {w} {lists} else {walk} end"


def surrogate(m: str, key: str) -> str:
    """SQL for the surrogate of the matched text m."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    email = f"concat({permuted(f'regexp_extract({m}, {_q(r'^(.*)@')}, 1)', key, 'local')}, '@', {permuted(f'regexp_extract({m}, {_q(r'@(.*)[.][^.]*$')}, 1)', key, 'domain')}, '.', regexp_extract({m}, {_q(r'[.]([^.]*)$')}, 1))"
    octets = f"transform(split({m}, '[.]'), o -> int(o))"
    add = lambda i, a, b: f"pmod(cast(conv(substr(sha2(cast(concat({_q(f'{key}|ipv4|{i}|')}, {a}, '|', {b}) as binary), 256), {{}}, 2), 16, 10) as int), 256)"
    ip = "q"
    for i in range(4):
        one, two, low, high = ("q[0]", "q[1]", 2, 3) if i % 2 == 0 else ("q[2]", "q[3]", 0, 1)
        new = [f"q[{k}]" for k in range(4)]
        new[low], new[high] = (f"(q[{k}] + {add(i, one, two).format(1 + 2 * j)}) % 256" for j, k in enumerate((low, high)))
        ip = f"transform(array({octets if i == 0 else ip}), q -> array({', '.join(new)}))[0]"
    ip = f"array_join(transform({ip}, o -> string(o)), '.')"
    tail = let(f"greatest(0, length(z) - 10)", "k", f"concat(substr(z, 1, k), {permuted('substr(z, k + 1)', key, 'phone')})")
    phone = let(digits, "z", let(tail, "y", _put_digits(m, "y")))
    ssn = let(digits, "z", let(permuted("z", key, "ssn"), "y", _put_digits(m, "y")))
    body = f"concat(substr(z, 1, 1), {permuted('substr(z, 2, length(z) - 2)', key, 'card')})"
    check = f"string(({_luhn('y')} + int(substr(z, length(z), 1)) - {_luhn('substr(z, 1, length(z) - 1)')} + 10) % 10)"
    card = let(digits, "z", let(body, "y", let(f"concat(y, {check})", "x", _put_digits(m, "x"))))
    name = f"array_join(transform(split({m}, ' '), w -> {name_word('w', key)}), ' ')"
    anchored = lambda p: f"{m} rlike {_q('^(?:' + p + ')$')}"
    made = {"email": email, "ipv4": ip, "card": card, "phone": phone, "ssn": ssn, "name": name}
    return "case " + " ".join(f"when {anchored(KINDS[k])} then {made[k]}" for k in KINDS) + f" else {m} end"


def kind_of(m: str) -> str:
    return "case " + " ".join(f"when {m} rlike {_q('^(?:' + p + ')$')} then '{k}'" for k, p in KINDS.items()) + " else 'other' end"


def _identity(kind: str, m: str) -> str:
    """SQL: what makes an entity that one, whatever its case and punctuation."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return f"concat({kind}, ' ', case when {kind} = 'phone' then right({digits}, 10) when {kind} in ('card', 'ssn') then {digits} else lower({m}) end)"


def _found(docs: DataFrame, key: str, column: str) -> DataFrame:
    """docs with _found, the entities of a text in their order: kind, entity, surrogate."""
    t, p = f"`{column}`", _q(ANY)
    kind = "array<struct<kind: string, m: string, s: string>>"
    each = f"struct({kind_of('m')} as kind, m, {surrogate('m', key)} as s)"
    return docs.withColumn("_found", F.expr(f"case when {t} rlike {_q(HINT)} and {t} rlike {p} then transform(regexp_extract_all({t}, {p}, 0), m -> {each}) else cast(array() as {kind}) end"))


def _rewritten(key: str, column: str) -> str:
    """SQL: the text with its entities' surrogates, also for words of its names where they stand alone."""
    t, p, word = f"`{column}`", _q(ANY), _q(rf"(?<!\p{{L}}){_WORD}(?!\p{{L}})")
    names = f"filter(flatten(transform(filter(_found, f -> f.kind = 'name'), f -> split(f.m, ' '))), w -> rtrim('.', w) not in ({', '.join(map(_q, TITLES))}))"
    bare, ending = _q("['’]s$"), "regexp_replace(w, {0}, '')"
    base = ending.format(bare)
    own = f"case when w is null then '' when array_contains(names, {base}) then concat(transform(array({base}), b -> {name_word('b', key)})[0], substr(w, length({base}) + 1)) else w end"
    gap = f"case when exists(names, n -> instr(g, n) > 0) then array_join(flatten(zip_with(split(g, {word}, -1), regexp_extract_all(g, {word}, 0), (x, w) -> array(x, {own}))), '') else g end"
    return f"""case when size(_found) = 0 then {t} else transform(array(array_distinct({names})), names ->
        array_join(flatten(zip_with(split({t}, {p}, -1), _found, (g, f) -> array({gap}, coalesce(f.s, '')))), ''))[0] end"""


def replace(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with every entity of `column` replaced by its surrogate under the key; all other columns stay.

    Null stays null and empty stays empty. Equal rows give equal rows. One scan tells most texts that hold nothing. An
    empty table gives none; a column named _found is not allowed.
    """
    return _found(docs, key, column).withColumn(column, F.expr(_rewritten(key, column))).drop("_found")


def report(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs as replace gives them, with one column n_<kind> for each kind of entity (0 for null) and n_collisions: how
    many of a text's entities share their surrogate with another one (none, by construction).

    A column of docs that has such a name keeps it; the new one then takes underscores behind its own until it is free.
    """
    found = _found(docs, key, column)
    new = {f"n_{k}": F.expr(f"cast(size(filter(_found, x -> x.kind = '{k}')) as bigint)") for k in KINDS}
    distinct = lambda m: f"size(array_distinct(transform(_found, x -> {_identity('x.kind', m)})))"
    new["n_collisions"] = F.expr(f"cast({distinct('x.m')} - {distinct('x.s')} as bigint)")
    columns = [F.expr(_rewritten(key, column)).alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns]
    for name, value in new.items():
        while name.lower() in (c.lower() for c in docs.columns):
            name += "_"
        columns.append(value.alias(name))
    return found.select(columns)


def entities(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(kind, entity, surrogate, n) over the corpus; equal entities are summed before the shuffle."""
    found = docs.select(F.explode(F.expr(f"regexp_extract_all(`{column}`, {_q(ANY)}, 0)")).alias("m"))
    counted = found.groupBy("m").agg(F.count("*").alias("n"))
    return counted.select(F.expr(kind_of("m")).alias("kind"), F.col("m").alias("entity"), F.expr(surrogate("m", key)).alias("surrogate"), "n")


def collisions(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Surrogates that stand for two entities of a corpus: none, by construction."""
    e = entities(docs, key, column).select("kind", F.expr(_identity("kind", "entity")).alias("entity"), F.expr(_identity("kind", "surrogate")).alias("surrogate"))
    return e.groupBy("kind", "surrogate").agg(F.count_distinct("entity").alias("n")).where("n > 1")
