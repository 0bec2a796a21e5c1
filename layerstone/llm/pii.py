"""Surrogates for personal data and secrets (operator 5), in DataFrame functions only.

Detected entities are cut into units: an address into its local part and its domain, a name into
given and family names, an assignment into its value. Every distinct unit of the corpus gets one
surrogate, so mentions that refer to the same thing still do (coreference), whatever their case or
punctuation. A surrogate is drawn by a keyed hash and is consistent with its type: digits become
digits, letters letters of the same script and case, hexadecimal stays hexadecimal, card numbers stay
valid, an IP address stays one, given names keep the gender that the title tells. Names are told by a
title or by words that introduce one ("my name is"); other names are not looked for.

Collision check: units of a kind whose surrogates coincide, or whose surrogate is some unit that the
corpus itself holds, are drawn again with the next attempt number until all are distinct. Where they
never are, the operator fails rather than return a mapping that confuses two units.

Documents without a possible entity are passed on unread by all that follows. The others are joined
with their units' surrogates; a unit that very many documents mention is an ordinary skewed equality
join, which adaptive execution splits.

Defined results: a null text stays null, an empty one empty; repeated rows give repeated results;
null doc_ids and clashing column names do no harm, as rows are matched by a number of our own; an
empty table gives no rows; columns other than text are kept as they are.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerstone.llm.common import fresh, materialize

#: The session setting that holds the key.
KEY_SETTING = "spark.layerstone.pii.key"
#: Attempts in a unit's own form. A form that has fewer values than the corpus has units cannot keep
#: them distinct; from then on surrogates get longer, and after MOST attempts the operator fails.
ATTEMPTS, MOST = 24, 60

# What is detected, in order of precedence. Java regular expressions. Secrets are of any
# length and taken whole; upper bounds are those of the notation itself.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
HEX4 = r"[0-9A-Fa-f]{1,4}"
NAME = r"\p{Lu}[\p{L}'’-]+"
TITLES = {"m": ("Mr", "Sr", "Herr", "Monsieur", "Señor", "Господин", "г-н"), "f": ("Mrs", "Ms", "Miss", "Sra", "Srta", "Frau", "Mme", "Madame", "Señora", "Госпожа", "г-жа"), "n": ("Dr", "Prof")}
DOTTED, PLAIN = "Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Srta", "Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Господин|Госпожа|г-н|г-жа"
SECRET_WORD = r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)"
ASSIGNED = rf"""(?<![\p{{L}}\p{{N}}]){SECRET_WORD}["']?\s{{0,3}}[:=]\s{{0,3}}["']?"""
LOCAL = r"0\d{1,4}[ /-]\d{3,4}[ -]?\d{2,5}(?:[ -]?\d{1,4})?|0\d(?:[ .]\d{2}){4}|[679]\d{2} \d{3} \d{3}|[679]\d{2}(?: \d{2}){3}"
CUE = r"(?i:my name is|ich heiße|mein Name ist|je m'appelle|mon nom est|me llamo|mi nombre es|меня зовут|name:|signed,?|sincerely,?|regards,?)\s"
VALUE = r"""(?=[^\s"',;\d]*+\d)[^\s"',;]{6,}+"""
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "assigned": ASSIGNED + VALUE,
    "web_token": r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "cloud_key": r"\bA[KS]IA[0-9A-Z]{16}\b",
    "service_key": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35})",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,126}\p{L}{2,63}",
    "mac": r"(?<![:\p{XDigit}-])(?=[\p{XDigit}:-]{0,16}\d)(?:\p{XDigit}{2}[:-]){5}\p{XDigit}{2}(?![:\p{XDigit}-])",
    "ipv6": rf"(?<![:\p{{XDigit}}])(?=[\p{{XDigit}}:]{{0,38}}\d)(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}})(?![:\p{{XDigit}}])",
    "ipv4": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|" + LOCAL + r")(?!\d|[.,-]\d)",
    "card": r"(?<![\d.,])(?:[3-6]\d{12,18}|[3-6]\d{3}(?:[ -]\d{4}){3}|3\d{3}[ -]\d{6}[ -]\d{5})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{DOTTED})\.|(?:{PLAIN})) {NAME}(?: {NAME}){{0,2}}",
    "introduced": rf"(?<!\p{{L}}){CUE}{NAME} {NAME}(?: {NAME})?",
}
#: All of them; none but a key block begins inside a word, and telling that first spares most places the search.
ANY = PATTERNS["private_key"] + r"|(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "private_key") + ")"
#: What every text with an entity has: a digit, an at sign, or the start of a key block or of a name.
POSSIBLE = "[0-9@]"
CUES = rf"(?<!\p{{L}}){CUE}\p{{Lu}}"
STARTS = ["-----BEGIN ", *(f"{t}. " for t in DOTTED.split("|")), *(f"{t} " for t in PLAIN.split("|"))]


def _possible(text: Column) -> Column:
    """Separate plain searches, which are several times as fast as one pattern of alternatives."""
    return reduce(lambda found, start: found | text.contains(start), STARTS, text.rlike(POSSIBLE)) | text.rlike(CUES)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _letters(first: int, last: int) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if c.isalpha() and c.islower())


#: Letters that stand for one another: within a script only.
DIGITS, HEXADECIMAL = "0123456789", "0123456789abcdef"
ALPHABETS = [_letters(0x61, 0x7A), _letters(0xDF, 0x17F), _letters(0x3B1, 0x3C9), _letters(0x430, 0x44F), "".join(map(chr, range(0x5D0, 0x5EB))), "".join(map(chr, range(0x3041, 0x3094))), "".join(map(chr, range(0x30A1, 0x30F7)))]
#: Syllables of made-up names by script: consonants, vowels, endings for a man, a woman, either and a family.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": "nrsk", "f": "a", "n": "eiy", "family": "rnlt"}),
    "greek": ("βγδκλμνπρστ", "αεηιου", {"m": "ς", "f": "α", "n": "ι", "family": "ς"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "нрлк", "f": "а", "n": "и", "family": ("ов", "ев", "ин")}),
}


def _part(literal: Column | str, kind: Column | str | None = None, raw: Column | str = "", norm: Column | str = "") -> Column:
    """A literal and the unit after it; kind is null where none follows."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(literal).cast("string").alias("literal"), as_column(kind).cast("string").alias("kind"), as_column(raw).cast("string").alias("raw"), as_column(norm).cast("string").alias("norm"))


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def _parts(entity: Column) -> Column:
    """The parts of one entity, by its type."""
    cut = lambda pattern, group: F.regexp_extract(entity, pattern, group)
    address = r"^(.*)@(.*)\.([^.]*)$"
    email = F.array(_part("", "email", cut(address, 1), F.lower(entity)), _part("@", "domain", cut(address, 2), F.lower(cut(address, 2))), _part(F.concat(F.lit("."), cut(address, 3))))
    assigned = rf"(?s)^({ASSIGNED})(.*)$"
    value = cut(assigned, 2)
    secret = F.array(_part(cut(assigned, 1), F.when(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "hexadecimal").otherwise("secret"), value, value))
    lead = F.regexp_extract(entity, rf"^({CUE})", 1)
    introduced = lead != ""
    # what stands before the names counts as one word, so that a title and a cue are treated alike
    words = F.when(introduced, F.concat(F.array(F.rtrim(lead)), F.split(F.substr(entity, F.char_length(lead) + 1), " "))).otherwise(F.split(entity, " "))
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = reduce(lambda rest, g: F.when(title.isin(*TITLES[g]), g).otherwise(rest), TITLES, F.lit("n"))
    last = F.size(words) - 2
    base = lambda w: F.regexp_replace(F.lower(w), "(ов|ев|ин)а$", "$1")
    name = F.transform(
        F.slice(words, F.lit(2), F.size(words)),
        lambda w, i: _part(F.when(i == 0, F.when(introduced, lead).otherwise(F.concat(words[0], F.lit(" ")))).otherwise(" "), F.when(i == last, "family").otherwise(F.concat(F.lit("given_"), gender)), w, F.when(i == last, base(w)).otherwise(F.lower(w))),
    )
    # the same number in another notation is the same unit; keys and addresses are matched as they stand
    loose, exact = ("iban", "phone", "card", "social", "mac"), ("private_key", "web_token", "cloud_key", "service_key", "ipv6", "ipv4")
    others = F.lit(None)
    for kind in reversed([k for k in PATTERNS if k in loose + exact]):
        others = F.when(entity.rlike(f"^(?:{_inside(kind)})$"), F.array(_part("", kind, entity, _plain(entity) if kind in loose else entity))).otherwise(others)
    return F.when(entity.rlike(rf"(?s)^{ASSIGNED}."), secret).when(introduced | entity.rlike(rf"^(?:(?:{DOTTED})\.|(?:{PLAIN})) "), name).when(entity.rlike("^[^@]+@[^@]+$"), email).otherwise(others)


def _inside(kind: str) -> str:
    """A pattern without what it asks of its surroundings."""
    import re

    return re.sub(r"\(\?<?!(?:[^()\[\]]|\[[^\]]*\])*\)", "", PATTERNS[kind])


def _draws(seed: Column, n: Column) -> Column:
    """At least n keyed bytes as integers; seed already holds the key."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", b.cast("string"), seed), 256))
    byte = lambda of, i: F.conv(F.substring(F.get(of, F.floor(i / 32).cast("int")), (i % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return _let(blocks, lambda of: F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: byte(of, i)))


def _turned(c: Column, alphabet: str, draw: Column) -> Column:
    """Another character of the alphabet than c, which is one of it."""
    n = len(alphabet)
    return F.substring(F.lit(alphabet), (F.pmod(F.instr(F.lit(alphabet), c) + draw % (n - 1), F.lit(n)) + 1).cast("int"), F.lit(1))


def _substituted(kind: Column, norm: Column, draws: Column, keep_first: Column) -> Column:
    """norm with every character after the first keep_first exchanged for another of its class."""

    def one(i: Column, at: Column) -> Column:
        c, low, draw = at["c"], at["low"], at["draw"]
        cased = lambda x: F.when(c == low, x).otherwise(F.upper(x))
        block = F.ascii(c) - F.ascii(c) % 32 + (F.ascii(c) % 32 + 1 + draw % 31) % 32
        other = F.when(c.rlike(r"[^\p{L}\p{N}]"), c).when(F.ascii(c) < 65536, F.decode(F.unhex(F.lpad(F.hex(block), 4, "0")), "UTF-16BE")).otherwise("x")
        for alphabet in reversed(ALPHABETS):
            other = F.when(F.contains(F.lit(alphabet), low), cased(_turned(low, alphabet, draw))).otherwise(other)
        other = F.when(c.between("0", "9"), _turned(c, DIGITS, draw)).otherwise(other)
        other = F.when(kind.isin("hexadecimal", "mac", "ipv6") & F.contains(F.lit(HEXADECIMAL), low), cased(_turned(low, HEXADECIMAL, draw))).otherwise(other)
        return F.when(i < keep_first, c).otherwise(other)

    def place(chars: Column, i: Column) -> Column:
        c = F.coalesce(F.get(chars, i), F.lit(""))
        return _let(F.struct(c.alias("c"), F.lower(c).alias("low"), F.get(draws, i).alias("draw")), lambda at: one(i, at))

    every = F.sequence(F.lit(0), F.greatest(F.char_length(norm), F.lit(1)) - 1)
    return _let(F.split(norm, ""), lambda chars: F.array_join(F.transform(every, lambda i: place(chars, i)), ""))


def _made_up(norm: Column, role: Column, draws: Column) -> Column:
    """A pronounceable name of two to four syllables in norm's script, with the ending of its role."""

    def spelled(script: str) -> Column:
        consonants, vowels, endings = SYLLABLES[script]
        pick = lambda letters, draw: F.get(F.array(*map(F.lit, letters)), draw % len(letters))
        syllable = lambda i: F.concat(pick(consonants, F.get(draws, i * 2)), pick(vowels, F.get(draws, i * 2 + 1)))
        body = F.array_join(F.transform(F.sequence(F.lit(0), 1 + F.get(draws, F.lit(30)) % 3), syllable), "")
        ending = reduce(lambda rest, r: F.when(role == r, pick(endings[r], F.get(draws, F.lit(31)))).otherwise(rest), endings, F.lit(""))
        stem = F.when(ending.isin(*vowels), F.concat(body, pick(consonants, F.get(draws, F.lit(29))))).otherwise(body)
        return F.concat(stem, ending)

    return F.when(norm.rlike(r"\p{IsCyrillic}"), spelled("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), spelled("greek")).otherwise(spelled("latin"))


def _surrogate(kind: Column, unit: Column, norm: Column, keep: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit for one attempt: of norm's form, drawn for the whole unit."""
    message = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), unit), 256)
    seed = F.concat(F.lit(key), message)

    def card(changed: Column) -> Column:
        # a valid card number stays one: its last digit is the one that makes it so
        front = F.substring(changed, F.lit(1), F.char_length(changed) - 1)
        valid = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(front, d.cast("string"))), lambda x: F.call_function("luhn_check", x))
        return F.when(F.call_function("luhn_check", norm), F.get(valid, F.lit(0))).otherwise(changed)

    def drawn(draws: Column) -> Column:
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.get(draws, i) % 223 + 1).cast("string")), ".")
        changed = _substituted(kind, norm, draws, keep)
        names = F.when(kind.startswith("given_"), _made_up(norm, F.substring(kind, 7, 1), draws)).when(kind == "family", _made_up(norm, F.lit("family"), draws))
        return F.coalesce(names, F.when(kind == "card", _let(changed, card)).when(kind == "ipv4", ip).otherwise(changed))

    longer = F.when(F.lower(norm).rlike(r"^[^\p{L}]+$"), F.regexp_replace(message, "[^0-9]", "")).otherwise(F.translate(message, "0123456789", "ghijklmnop"))
    mark = F.when(attempt > ATTEMPTS, F.substring(longer, F.lit(1), (attempt - ATTEMPTS).cast("int"))).otherwise("")
    return F.concat(_let(_draws(seed, F.greatest(F.char_length(norm), F.lit(32))), drawn), mark)


def _kept(kind: Column, raw: Column) -> Column:
    """How many leading characters of the unit tell its type or country and stay."""
    country = F.char_length(F.regexp_extract(raw, r"^\+(\d{1,3}?)(?:[ .(-]|\d{8,}$)", 1))
    return F.when(kind == "phone", country).when(kind == "cloud_key", 4).when(kind == "service_key", F.char_length(F.regexp_extract(raw, "^(gh._|sk-|xox.-|AIza)", 1))).when(kind == "web_token", 3).when(kind == "iban", 2).when(kind == "card", 1).when(kind == "private_key", F.char_length(F.regexp_extract(raw, "^(-----BEGIN [A-Z ]*-----)", 1))).otherwise(0).cast("int")


def _mapping(units: DataFrame, key: str) -> DataFrame:
    """kind, norm, surrogate of distinct units (kind, norm, keep): distinct within a kind, and none of the corpus's own."""
    # of an address only the local part is exchanged here; its domain is a unit of its own
    form = F.when(F.col("kind") == "email", F.regexp_extract("norm", "^(.*)@", 1)).otherwise(F.col("norm"))
    drawn = _surrogate(F.col("kind"), F.col("norm"), form, F.col("keep"), F.col("attempt"), key)
    units = materialize(units, "units")
    n = units.count()
    now = materialize(units.withColumn("attempt", F.lit(0)).withColumn("surrogate", drawn), "units", n)
    for _ in range(MOST):
        first = Window.partitionBy("kind", "taken_as").orderBy("attempt", "norm")
        known = now.select("kind", F.col("norm").alias("own"))
        whole = F.when(F.col("kind") == "email", F.concat("surrogate", F.regexp_extract("norm", "(@.*)$", 1))).otherwise(F.col("surrogate"))
        placed = now.withColumn("taken_as", whole)
        real = placed.join(known.withColumnRenamed("kind", "own_kind"), (F.col("kind") == F.col("own_kind")) & (F.col("taken_as") == F.col("own")), "left").drop("own_kind")
        judged = real.withColumn("again", (F.row_number().over(first) > 1) | F.col("own").isNotNull())
        judged = materialize(judged.select("kind", "norm", "keep", "attempt", "surrogate", "again"), "units", n)
        if judged.filter("again").isEmpty():
            return judged.select("kind", "norm", "surrogate")
        redrawn = judged.filter("again").withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", drawn)
        now = materialize(judged.filter("not again").unionByName(redrawn).drop("again"), "units", n)
    raise RuntimeError(f"surrogates are not distinct after {MOST} attempts")


def _poured(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the raw unit's own notation: its punctuation and case."""
    loose = kind.isin("iban", "phone", "card", "social", "mac")
    n = F.sequence(F.lit(1), F.greatest(F.char_length(raw), F.lit(1)))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(state: Column, i: Column) -> Column:
        c, sign = F.substring(raw, i, F.lit(1)), F.substring(surrogate, state["at"], F.lit(1))

        def put(x: Column) -> Column:
            take = x["c"].rlike(r"[\p{L}\p{N}]")
            cased = F.when((F.upper(x["c"]) == x["c"]) & (F.lower(x["c"]) != x["c"]) | (kind == "mac") & (F.upper(raw) == raw), F.upper(x["sign"])).otherwise(x["sign"])
            return F.struct(F.when(take, state["at"] + 1).otherwise(state["at"]).alias("at"), F.concat(state["out"], F.when(take, cased).otherwise(x["c"])).alias("out"))

        return _let(F.struct(c.alias("c"), sign.alias("sign")), put)

    noted = F.aggregate(n, start, step, lambda state: F.concat(state["out"], F.substring(surrogate, state["at"], F.lit(64))))
    woman = (kind == "family") & F.lower(raw).rlike("(ов|ев|ин)а$")
    named = F.when(woman, F.concat(surrogate, F.lit("а"))).otherwise(surrogate)
    named = F.when((F.upper(raw) == raw) & (F.char_length(raw) > 1), F.upper(named)).otherwise(F.initcap(named))
    by_case = F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(surrogate)).when(F.substring(raw, 1, 1) != F.lower(F.substring(raw, 1, 1)), F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.char_length(surrogate)))).otherwise(surrogate)
    return F.when(loose, noted).when(kind.startswith("given_") | (kind == "family"), named).when(kind.isin("email", "domain"), by_case).otherwise(surrogate)


def session_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING. Unset, one is drawn and kept for the session: surrogates then agree within it and with no other."""
    key = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with every detected entity in text replaced; under count, if given, how many units were. Surrogates hang on key, which is a secret."""
    columns, text = docs.columns, F.col("text")
    number, parts, found = (fresh(docs, f"pii_{n}") for n in ("row", "parts", "found"))
    possible = F.coalesce(_possible(text), F.lit(False))
    untouched = docs.filter(~possible)
    if count:
        untouched = untouched.withColumn(count, F.lit(0))

    found_in = F.struct(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("entities"), F.split(text, ANY, -1).alias("between"))

    def cut(x: Column) -> Column:
        within = F.flatten(F.transform(x["entities"], lambda e, i: F.concat(F.array(_part(F.get(x["between"], i))), F.coalesce(_parts(e), F.array(_part(e))))))
        return F.concat(within, F.array(_part(F.element_at(x["between"], -1))))

    whole = _let(found_in, cut)
    rest = [c for c in columns if c != "text"]
    held = materialize(docs.filter(possible).select(*rest, F.monotonically_increasing_id().alias(number), whole.alias(parts)), "entities")

    unit = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("at"), p["kind"].alias("kind"), p["raw"].alias("raw"), p["norm"].alias("norm"))), lambda u: u["kind"].isNotNull())
    mentions = held.select(F.col(number).alias("row"), F.explode(unit).alias("u")).select("row", "u.*")
    kept = F.when(F.col("kind") == "email", F.lit(0)).otherwise(_kept(F.col("kind"), F.col("raw")))
    units = mentions.groupBy("kind", "norm").agg(F.min(kept).alias("keep"))
    mapping = _mapping(units, key)
    exchanged = mentions.join(mapping, ["kind", "norm"]).select("row", "at", _poured(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new"))
    by_row = exchanged.groupBy(F.col("row").alias("row_of")).agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias(found))
    joined = held.join(by_row, held[number] == by_row["row_of"], "left")
    pieces = F.transform(F.col(parts), lambda p, i: F.concat(p["literal"], F.coalesce(F.try_element_at(F.col(found), i), p["raw"])))
    changed = joined.withColumn("text", F.array_join(pieces, ""))
    if count:
        changed = changed.withColumn(count, F.coalesce(F.size(found), F.lit(0)))
        columns = [*columns, count]
    return untouched.select(*columns).unionByName(changed.select(*columns))
