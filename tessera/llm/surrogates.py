"""Surrogates for personal data, in DataFrame functions only.

Every detected value gets a replacement of its type and format, drawn from a
keyed digest of the value: digits become digits, letters letters of their case
and script, an address stays an address, card numbers and IBANs, which are only
taken for such if their checksum holds, get one that holds, and a name keeps the
gender of its title. One value has one replacement in all
documents, whatever its case (coreference); two values never share one
(distinctness): replacements are compared over all values, and where two meet,
or one equals a value of the data, the loser draws again.

Domains, and the values of a form that is so crowded that draws don't settle
(the 10,000 addresses of four one-digit octets, say), go through a keyed
permutation of all values of their form: it keeps the form, no two values meet
in it, and none stays as it was. In a crowded form a replacement may be another
value of the data, as more than half of the form is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, attach, group_facts, read_table, salt_of, staged

# What is detected, by type, first match first.
MALE = "Mr|Herr|Monsieur|Señor|Sr"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Señorita|Sra"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-@])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    "ipv4": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[A-F]*[0-9])[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])[0-9]{4}([ \-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+(?=(?:[ .\-]?[0-9]){8,15}(?![ .\-]?[0-9]))[0-9]{1,3}(?:[ .\-]?[0-9]{1,4}){2,6}|(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE})\.? \p{{Lu}}\p{{Ll}}+(?:[ \-]\p{{Lu}}\p{{Ll}}+){{0,2}}",
}
#: Any of them; no match begins inside a word, so the rest of a word is passed quickly.
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(p.replace(r"([ \-]?)", r"(?<gap>[ \-]?)").replace(r"\1", r"\k<gap>") for p in PATTERNS.values()) + ")"
# Alphabets that letters are drawn from, by script and case.
ALPHABETS = (
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[à-öø-þ]", "àáâäãåæçèéêëìíîïðñòóôöõøùúûüýþ"),
    ("[À-ÖØ-Þ]", "ÀÁÂÄÃÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÖÕØÙÚÛÜÝÞ"),
    ("[а-я]", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    ("[А-Я]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
)
# Syllables that names are built from, and the endings that mark a given name's gender.
NAME_LATIN = "ba be bi bo da de di do fa fe fi fo ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo".split()
NAME_CYRILLIC = "ба бе би бо ва ве ви во га го да де ди до за зе зи зо ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по ра ре ри ро са се си со та те ти то".split()
ENDINGS = {"f": ("na", "lia", "на", "лия"), "m": ("n", "rd", "н", "рд"), "s": ("ner", "son", "нов", "ский")}
#: What looks like a value but isn't one stays as it is.
NOTHING = "nothing"
#: A form with a value that this many draws have not settled is permuted as a whole.
LAST_DRAW = 12
#: The draw of a value whose form is permuted.
PERMUTED = -1
ROUNDS = 4


def _may_hold() -> Column:
    """False only for texts that can't match: all but names have a digit or one of a few marks."""
    titles = [t for t in f"{FEMALE}|{MALE}".split("|") if not any(t != o and t.startswith(o) for o in f"{FEMALE}|{MALE}".split("|"))]
    held = F.col("text").rlike("[0-9]")
    for mark in ("@", "AKIA", "_", "sk-", *titles):
        held = held | F.contains("text", F.lit(mark))
    return held


def _type(value: str) -> Column:
    kind = None
    for name, p in PATTERNS.items():
        if name == "secret":  # letters and digits in one run: a card has digits only
            p = rf"(?!^[0-9]{{32,}}$){p}"
        test = F.col(value).rlike(f"^(?:{p})$")
        kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))
    kind = kind.otherwise(F.lit("secret"))
    # digits that fail the check are no card number or IBAN
    held = F.expr(f"{_luhn(value)} = 0"), F.expr(f"{_mod97(value)} = 1")
    return F.when((kind == "card") & ~held[0], F.lit(NOTHING)).when((kind == "iban") & ~held[1], F.lit(NOTHING)).otherwise(kind)


def _literal(key: str) -> str:
    return "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(key: str, *parts: str) -> str:
    """SQL for 192 hexadecimal digits of key and parts."""
    what = ", ".join([_literal(key), *parts])
    return "concat(" + ", ".join(f"sha2(concat_ws('|', {what}, '{i}'), 256)" for i in range(3)) + ")"


def _draw(digest: str, i: str) -> str:
    """SQL for a number under 65536 from place i (from 1) of the digest."""
    return f"CAST(conv(substr({digest}, (({i}) * 3) % 188 + 1, 4), 16, 10) AS INT)"


def _same_format(value: str, digest: str, keep: str = "false") -> str:
    """SQL: each digit and letter of value replaced by one of its kind, but where keep(i, c) holds."""
    cases = f"WHEN {keep} THEN c.s WHEN c.s RLIKE '[0-9]' THEN CAST({_draw(digest, 'c.i')} % 10 AS STRING) "
    for test, letters in ALPHABETS:
        cases += f"WHEN c.s RLIKE '{test}' THEN substr('{letters}', {_draw(digest, 'c.i')} % {len(letters)} + 1, 1) "
    chars = f"transform(sequence(1, length({value})), i -> named_struct('i', i, 's', substr({value}, i, 1)))"
    return f"array_join(transform(CASE WHEN length({value}) > 0 THEN {chars} END, c -> CASE {cases} ELSE c.s END), '')"


def _cells(value: str, keep: str) -> str:
    """SQL: per character its place i, itself s, the alphabet a it may change in ('' if it stays), its place v there and the alphabet's size n."""
    letters = f"CASE WHEN {keep} THEN '' WHEN c.s RLIKE '[0-9]' THEN '0123456789' "
    for test, alphabet in ALPHABETS:
        letters += f"WHEN c.s RLIKE '{test}' THEN '{alphabet}' "
    letters += "ELSE '' END"
    chars = f"CASE WHEN length({value}) > 0 THEN transform(sequence(1, length({value})), i -> named_struct('i', i, 's', substr({value}, i, 1))) END"
    cell = "named_struct('i', c.i, 's', c.s, 'a', a, 'v', greatest(instr(a, c.s) - 1, 0), 'n', CASE WHEN instr(a, c.s) > 0 THEN length(a) ELSE 1 END)"
    return f"transform({chars}, c -> {_let('a', letters, cell)})"


def _octets(value: str) -> str:
    """SQL: the cells of an address; an octet stays within those of its length."""
    n = "element_at(array(10, 90, 156), length(o))"
    return f"transform(split({value}, '[.]'), (o, i) -> named_struct('i', i + 1, 's', o, 'a', o, 'v', CAST(o AS INT) - element_at(array(0, 10, 100), length(o)), 'n', {n}))"


def _permuted(cells: str, key: str, form: str, write: str) -> str:
    """SQL: the parts of a value, as an array, after a keyed permutation of all values with these cells' alphabets.

    Places go to two halves in turn; in each round every place of one half is
    moved on by a digest of the other half (a Feistel network on digits of mixed
    radix). Those rounds, one step at the first place, and the rounds undone, make
    a permutation that leaves no value as it is. ``write`` makes a part of the
    cell c and its new place w.
    """
    def step(x: str, r: int, sign: str) -> str:
        other = f"array_join(transform(filter({x}, (d, j) -> j % 2 <> {r % 2}), d -> CAST(d.v AS STRING)), ',')"
        digest = f"sha2(concat_ws('|', {_literal(key)}, 'round', {form}, '{r}', {other}), 512)"
        moved = f"pmod(c.v {sign} CAST(conv(substr(g, (j * 3) % 120 + 1, 5), 16, 10) AS INT), c.n)"
        return _let("g", digest, f"transform({x}, (c, j) -> CASE WHEN j % 2 = {r % 2} THEN named_struct('i', c.i, 'n', c.n, 'v', {moved}) ELSE c END)")

    steps = [("+", r) for r in range(ROUNDS)] + [("1", 0)] + [("-", r) for r in reversed(range(ROUNDS))]
    names = [f"x{i}" for i in range(len(steps) + 1)]
    last = names[-1]
    body = f"transform(cells, c -> {_let('w', f'try_element_at(filter({last}, d -> d.i = c.i), 1).v', write)})"
    for i in reversed(range(len(steps))):
        sign, r = steps[i]
        x = names[i]
        one = f"transform({x}, (c, j) -> named_struct('i', c.i, 'n', c.n, 'v', CASE WHEN j = 0 THEN pmod(c.v + 1, c.n) ELSE c.v END))"
        body = _let(names[i + 1], one if sign == "1" else step(x, r, sign), body)
    open_ = "transform(filter(cells, c -> c.n > 1), c -> named_struct('i', c.i, 'n', c.n, 'v', c.v))"
    return _let("cells", cells, _let("x0", open_, body))


def _permuted_text(value: str, key: str, form: str, keep: str = "false") -> str:
    """SQL: each digit and letter of value, but where keep holds, replaced by one of its kind, by :func:`_permuted`."""
    write = "CASE WHEN c.n > 1 THEN substr(c.a, w + 1, 1) ELSE c.s END"
    return f"CASE WHEN length({value}) > 0 THEN array_join({_permuted(_cells(value, keep), key, form, write)}, '') ELSE {value} END"


def _form(value: str) -> str:
    """SQL for what a permutation keeps of a value; equal for all values that it may exchange."""
    shape = "regexp_replace(regexp_replace({}, '[0-9]', '0'), '\\\\p{{L}}', 'a')"
    return f"CASE kind WHEN 'email' THEN concat({shape.format(f'substring_index({value}, {quote(chr(64))}, 1)')}, '@', substring_index({value}, '@', -1)) ELSE {shape.format(value)} END"


def _luhn(number: str) -> str:
    """SQL: the weighted digit sum of a number, modulo ten; 0 where its check digit holds."""
    digit = "CAST(substr(d, length(d) - i, 1) AS INT)"
    total = f"aggregate(sequence(0, length(d) - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10"
    return _let("d", f"regexp_replace({number}, '[^0-9]', '')", total)


def _mod97(number: str) -> str:
    """SQL: the remainder of an IBAN, its first four places moved to the end; 1 where it holds."""
    digit = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(r, i, 1)) - 1"
    total = f"aggregate(transform(sequence(1, length(r)), i -> {digit}), 0, (a, d) -> (a * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97)"
    return _let("s", f"upper(replace({number}, ' ', ''))", _let("r", "concat(substr(s, 5), substr(s, 1, 4))", total))


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value, which is so written and computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _name(part: str, key: str, role: str, gender: str) -> str:
    """SQL for a name in the script of part: three syllables and an ending, a syllable more with each draw."""
    latin = "array(" + ", ".join(f"'{x}'" for x in NAME_LATIN) + ")"
    cyrillic = "array(" + ", ".join(f"'{x}'" for x in NAME_CYRILLIC) + ")"

    def end(g):
        a, b, c, d = ENDINGS[g]
        return f"element_at(CASE WHEN y THEN array('{c}', '{d}') ELSE array('{a}', '{b}') END, {_draw('g', '50')} % 2 + 1)"

    ending = end("s") if role == "family" else f"CASE WHEN {gender} = 'f' THEN {end('f')} ELSE {end('m')} END"
    syllables = _let("t", f"CASE WHEN y THEN {cyrillic} ELSE {latin} END", f"array_join(transform(sequence(1, 3 + draw), k -> element_at(t, {_draw('g', 'k')} % size(t) + 1)), '')")
    body = f"initcap(concat({syllables}, {ending}))"
    digest = _digest(key, "'name'", f"'{role}'", gender, f"lower({part})", "CAST(draw AS STRING)")
    return _let("g", digest, _let("y", f"{part} RLIKE '\\\\p{{IsCyrillic}}'", body))


def with_surrogate(rows: DataFrame, key: str, value: str = "value") -> DataFrame:
    """``rows`` (kind, value, draw) with new, the replacement of the value at its draw."""
    e = F.expr
    domain = f"substring_index({value}, '@', -1)"
    rows = rows.withColumn("__g", e(_digest(key, "kind", f"lower({value})", "CAST(draw AS STRING)")))
    rows = rows.withColumn("__host", e(f"CASE WHEN kind = 'email' THEN substr({domain}, 1, length({domain}) - length(substring_index({domain}, '.', -1))) END"))
    rows = rows.withColumn("__body", e(f"CASE WHEN kind = 'email' THEN substring_index({value}, '@', 1) ELSE {value} END"))
    # what stays: the country's code, an issuer's first digit, a key's prefix, and the exchange 555, which belongs to nobody
    rows = rows.withColumn("__keep", e(
        f"CASE kind WHEN 'phone' THEN length(regexp_extract({value}, '^[+][0-9]{{1,3}}', 0)) WHEN 'card' THEN 1 WHEN 'iban' THEN 2 "
        f"WHEN 'secret' THEN length(regexp_extract({value}, '^(AKIA|gh[a-z]_|sk-)', 1)) ELSE 0 END"))
    rows = rows.withColumn("__555", e(f"CASE WHEN kind = 'phone' AND draw <> {PERMUTED} AND {value} RLIKE '[ .)-]555[ .-][0-9]{{4}}$' THEN length({value}) - 8 ELSE -9 END"))
    keep = "c.i <= __keep OR (c.i > __555 AND c.i <= __555 + 3)"
    # check digits follow from the rest
    fixed = f"{keep} OR (kind = 'card' AND c.i = length({value})) OR (kind = 'iban' AND c.i <= 4)"
    whose = f"concat(kind, CASE WHEN kind = 'email' THEN lower({domain}) ELSE '' END)"
    rows = rows.withColumn("__raw", e(f"CASE WHEN draw = {PERMUTED} THEN {_permuted_text('__body', key, whose, fixed)} ELSE {_same_format('__body', '__g', keep)} END"))
    # a domain has one replacement, whoever has addresses there, and two domains never share one
    rows = rows.withColumn("__hosts", e(f"CASE WHEN kind = 'email' THEN {_permuted_text('__host', key, quote('domain'))} END"))
    rows = rows.withColumn("__blank", e(f"CASE WHEN kind = 'card' AND {_luhn(value)} = 0 THEN concat(substr(__raw, 1, length({value}) - 1), '0') END"))
    octet = (f"CAST(CASE length(o) WHEN 1 THEN {_draw('__g', 'i + 1')} % 10 WHEN 2 THEN 10 + {_draw('__g', 'i + 1')} % 90 ELSE 100 + {_draw('__g', 'i + 1')} % 156 END AS STRING)")
    octets = f"array_join({_permuted(_octets(value), key, 'kind', 'CAST(w + element_at(array(0, 10, 100), length(c.s)) AS STRING)')}, '.')"
    hexes = f"array_join(transform(sequence(1, length({value})), i -> substr(CASE WHEN {value} RLIKE '[a-f]' THEN '0123456789abcdef' ELSE '0123456789ABCDEF' END, {_draw('__g', 'i')} % 16 + 1, 1)), '')"
    zeros = "concat(substr(__raw, 1, 2), '00', substr(__raw, 5))"
    gender = f"CASE WHEN {value} RLIKE '^({FEMALE})[. ]' THEN 'f' ELSE 'm' END"
    title = f"regexp_extract({value}, '^([^ ]+ )', 1)"
    person = _let("p", f"split(substr({value}, length({title}) + 1), '[ -]')", f"concat({title}, array_join(transform(p, (n, j) -> CASE WHEN j = size(p) - 1 THEN {_name('n', key, 'family', quote('x'))} ELSE {_name('n', key, 'given', gender)} END), ' '))")
    new = (
        f"CASE WHEN kind = 'email' THEN concat(__raw, '@', __hosts, substring_index({domain}, '.', -1)) "
        f"WHEN kind = 'ipv4' AND draw = {PERMUTED} THEN {octets} "
        f"WHEN kind = 'ipv4' THEN array_join(transform(split({value}, '[.]'), (o, i) -> {octet}), '.') "
        # the last digit makes up for the rest where the value's own check holds
        f"WHEN __blank IS NOT NULL THEN concat(substr(__raw, 1, length({value}) - 1), CAST((10 - {_luhn('__blank')}) % 10 AS STRING)) "
        f"WHEN kind = 'iban' THEN concat(substr(__raw, 1, 2), lpad(CAST(98 - {_mod97(zeros)} AS STRING), 2, '0'), substr(__raw, 5)) "
        f"WHEN kind = '{NOTHING}' THEN {value} WHEN kind = 'secret' AND {value} RLIKE '^[0-9a-fA-F]+$' THEN {hexes} WHEN kind = 'person' THEN {person} ELSE __raw END")
    rows = rows.withColumn("new", e(new))
    return rows.drop("__g", "__host", "__body", "__keep", "__555", "__raw", "__hosts", "__blank")


def quote(s: str) -> str:
    return f"'{s}'"


def draws(values: DataFrame, key: str) -> DataFrame:
    """(kind, canon, draw) of the values whose first draw collides; the others' draw is 0.

    ``values`` has distinct (kind, canon), canon in lower case; names are
    compared as written. Where a form is too crowded for LAST_DRAW draws, all its
    values have the draw PERMUTED. Names grow with each draw, and keys are long:
    their forms are never crowded.
    """
    values = staged(values, "values")
    held = values.select(F.col("canon").alias("new")).distinct().withColumn("real", F.lit(True))
    drawn = staged(with_surrogate(values.withColumn("draw", F.lit(0)), key, "canon"), "drawn")
    for i in range(2 * LAST_DRAW):
        # of the values that meet in one replacement the least keeps it
        met = drawn.groupBy("new").agg(F.min(F.struct("kind", "canon")).alias("first"), F.count("*").alias("n"), F.max(F.col("draw") == PERMUTED).alias("permuted"))
        # a permuted value is distinct from all of its form, and may be another of the data
        met = met.join(held, "new", "left").filter("n > 1 OR (real AND NOT permuted)").select("new", "first", F.coalesce("real", F.lit(False)).alias("real"))
        met = staged(met, "met")
        if met.isEmpty():
            return drawn.filter("draw <> 0").select("kind", "canon", "draw")
        lost = F.col("real").isNotNull() & (F.col("real") | (F.struct("kind", "canon") != F.col("first"))) & (F.col("draw") != PERMUTED)
        again = drawn.join(met, "new", "left").withColumn("lost", F.coalesce(lost, F.lit(False))).select("kind", "canon", "draw", "lost")
        if i >= LAST_DRAW:
            again = again.withColumn("form", F.expr(f"CASE WHEN kind NOT IN ('person', 'secret') THEN {_form('canon')} END")).withColumn("__v", salt_of("canon"))
            again = staged(again, "again")
            crowded = again.filter("lost").select("kind", "form").distinct().withColumn("crowded", F.lit(True)).withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            again = again.join(crowded, ["kind", "form", "__v"], "left")
            drawing = F.col("draw") + F.col("lost").cast("int")
            again = again.withColumn("draw", F.when(F.col("crowded"), PERMUTED).otherwise(drawing))
        else:
            again = again.withColumn("draw", F.col("draw") + F.col("lost").cast("int"))
        drawn = staged(with_surrogate(again.select("kind", "canon", "draw"), key, "canon"), "drawn")
    raise ValueError("replacements still collide after the last draw")


def _canon(kind: str, value: str) -> Column:
    return F.when(F.col(kind) == "person", F.col(value)).otherwise(F.lower(value))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with text rewritten and n_entities, the number of values replaced.

    A null text stays null, with 0. Texts without a detected value pass
    through. Texts are read whole; rows that repeat a doc_id or a text get the
    same replacements. Where two values' replacements meet, the least keeps its.
    A column named n_entities is replaced, all others pass. An empty table gives
    no rows. ``key`` decides the replacements; without it they can't be redone.
    """
    docs = docs.drop("n_entities").withColumn("__e", F.when(_may_hold(), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    has = F.coalesce(F.size("__e") > 0, F.lit(False))
    clean = docs.filter(~has).drop("__e").withColumn("n_entities", F.lit(0))
    found = docs.filter(has).withColumn("__h", F.sha2(F.col("text").cast("binary"), 256)).withColumn("__salt", salt_of("doc_id"))
    # equal texts hold equal values; each is settled once
    texts = found.groupBy("__h").agg(F.first("__e").alias("e"), F.collect_set("__salt").alias("__salts"))
    texts = staged(texts, "found")
    mentions = texts.select("__h", F.posexplode("e").alias("at", "value")).withColumn("kind", _type("value")).withColumn("canon", _canon("kind", "value"))
    mentions = staged(mentions, "mentions")
    redrawn = draws(mentions.filter(F.col("kind") != NOTHING).select("kind", "canon").distinct(), key)
    # a frequent value is dealt over its texts' salts
    mentions = mentions.withColumn("__v", salt_of("__h"))
    spread = redrawn.withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    new = mentions.join(spread, ["kind", "canon", "__v"], "left").drop("__v").withColumn("draw", F.coalesce("draw", F.lit(0)))
    lists = with_surrogate(new, key).groupBy("__h").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("r"), F.count(F.when(F.col("kind") != NOTHING, 1)).alias("__n"))
    facts = texts.select("__h", "__salts").join(lists, "__h").select("__h", "__salts", F.col("r.new").alias("__new"), F.col("__n").cast("int").alias("__n"))
    joined = attach(found.drop("__e"), facts, "__h", "__salt")
    between = F.split("text", ANY, -1)
    rewritten = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size("__new")), F.col("__new"), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    done = joined.withColumn("text", rewritten).withColumn("n_entities", F.col("__n"))
    return clean.unionByName(done.select(clean.columns))


def op9_surrogates(spark, sf_dir):
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key="tessera-demo-key")
