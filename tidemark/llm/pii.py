"""PII: format-preserving Feistel pseudonyms.

What looks like personal data is found by one pattern and validated: payment cards by their check
digit, IBANs by theirs, social security numbers and IPv4 addresses by their ranges, dates by the
calendar. Each value then goes through a keyed Feistel network over exactly the values of its format:
the result has the same shape and validity, different values stay different, and equal values get
equal pseudonyms in all documents without any table that would link them. Whoever has the key can
invert it.

    kind    permuted                                     kept
    email   letters and digits before the @, by class    case, punctuation, domain
    secret  hexadecimal numbers of 32 digits or more     case; if mixed, capitals where there were some
    iban    letters and digits of the account, by class  country; check digits are computed anew
    date    days from 1900 to 2099                       order (day first where both fit), separators, whether the day is beyond the 12th
    ip      all 32 bits                                  -
    ssn     area, group and serial number in their ranges  -
    card    all digits but the last                      separators; the check digit is computed anew
    phone   up to 10 digits after the country code       country code, separators

IBANs are looked for first, as what else is in a text can only be told once it is known what they
cover: a run of groups that is no valid IBAN may hold a card. Columns of built-in functions only, in one pass without a shuffle.

Not looked for, and so left as they are: IPv6 addresses, IBANs in lower case, telephone numbers whose
groups are of other lengths than those above, and domains with letters beyond ASCII. Four numbers up to
255 between dots are taken for an address, even if they are a version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.llm.common import table

KEY = "tidemark pseudonyms, replace in production"
ROUNDS = 8

_FREE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV", 22: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
#: Those at just their length, then any country at any length.
_IBANS = [rf"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + _END for n, countries in IBAN_LENGTHS.items()]
_IBAN = "|".join([*_IBANS, rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"])
_YEAR, _UP_TO_31 = "(?:19|20)[0-9]{2}", "(?:0?[1-9]|[12][0-9]|3[01])"
#: Year first, or day and month in either order before the year.
_DATE = rf"(?:{_YEAR}-{_UP_TO_31}-{_UP_TO_31}|(?<!/){_YEAR}/{_UP_TO_31}/{_UP_TO_31}|{_YEAR}\.{_UP_TO_31}\.{_UP_TO_31}|(?<![0-9]\.){_UP_TO_31}[./-]{_UP_TO_31}[./-]{_YEAR})(?![0-9A-Za-z]|[-./][0-9])"
#: Kind and pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z][A-Za-z0-9-]+",
    "secret": rf"{_FREE}(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{{32,}}+{_END}",
    "iban": rf"{_FREE}(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})",
    "date": rf"{_FREE}{_DATE}",
    "ip": rf"{_FREE}(?<![0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ssn": rf"{_FREE}(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}{_END}",
    "card": rf"{_FREE}(?:[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}|[0-9]{{4}}([ -])[0-9]{{6}}\2[0-9]{{4,5}}|[0-9]{{13,19}}){_END}",
    "phone": rf"(?:\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{3}}\)?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|{_FREE}(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}|\+[0-9]{{10,14}}|\+[0-9]{{1,3}} [0-9]{{2,4}} [0-9]{{3,4}} [0-9]{{3,4}}){_END}",
}


#: The only groups are those of card separators, so their numbers are the same in the whole pattern.
PATTERN = "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "iban")
#: What every match has, and every IBAN: texts without it, most of them, are passed over by a simple scan.
GATE, IBAN_GATE = "[0-9@]", "[A-Z]{2}[0-9]{2}"


def number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def digest(*parts: Column | str) -> Column:
    """Round function: 128 hexadecimal digits."""
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 512)


def shifted(half: Column, digest_of_other: Column, hexadecimal: bool) -> Column:
    """Moves the i-th character within its class by the i-th byte of a digest; others stay. `half` is not empty."""

    def one(c: Column, i: Column, by: Column) -> Column:
        step = number(F.substring(by, (2 * (i % 64) + 1).cast("int"), F.lit(2)))
        if hexadecimal:
            return F.lower(F.hex((number(c) + step) % 16))
        code = F.ascii(c)
        digit, letter = c.between("0", "9"), (F.length(c) == F.octet_length(c)) & c.between("a", "z")
        return F.when(digit, F.char(48 + (code - 48 + step) % 10)).when(letter, F.char(97 + (code - 97 + step) % 26)).otherwise(c)

    return let(digest_of_other, lambda by: F.array_join(F.transform(F.split(half, ""), lambda c, i: one(c, i, by)), ""))


def permuted(value: Column, key: str, hexadecimal: bool = False) -> Column:
    """Feistel network over the characters of a lower-case string of two or more: its halves shift each other."""
    return let(value, lambda v: _permuted(v, key, hexadecimal))


def _permuted(value: Column, key: str, hexadecimal: bool) -> Column:
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, lambda x, r: F.struct(x["b"].alias("a"), shifted(x["a"], digest(f"{key}|", r, "|", x["b"]), hexadecimal).alias("b")), lambda x: F.concat(x["a"], x["b"]))


def permuted_pair(x: Column, y: Column, nx: int, ny: int, key: str) -> Column:
    """Feistel network over pairs of 0 <= x < nx, 0 <= y < ny: a struct of both."""

    def step(p: Column, r: Column) -> Column:
        first = (p["x"] + number(F.substring(digest(f"{key}|x|", r, "|", p["y"]), 1, 12))) % nx
        return F.struct(first.alias("x"), p["y"].alias("y"))

    def other(p: Column, r: Column) -> Column:
        second = (p["y"] + number(F.substring(digest(f"{key}|y|", r, "|", p["x"]), 1, 12))) % ny
        return F.struct(p["x"].alias("x"), second.alias("y"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda p, r: F.when(r % 2 == 1, step(p, r)).otherwise(other(p, r)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(shape: Column, chars: Column, fills: str) -> Column:
    """`shape` with its characters of class `fills` replaced by those of `chars` in turn; capitals stay capitals."""

    def one(i: Column, new_chars: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        new = F.substring(new_chars, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{fills}]", "")), F.lit(1))
        return F.when(~c.rlike(f"[{fills}]"), c).when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)

    return let(chars, lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: one(i, x)), ""))


def luhn(body: Column) -> Column:
    """The check digit that completes a string of digits."""

    def add(body: Column, total: Column, i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        twice = (F.length(body) - i) % 2 == 0
        return total + F.when(~twice, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return let(body, lambda b: F.pmod(-F.aggregate(F.sequence(F.lit(1), F.length(b)), F.lit(0), lambda total, i: add(b, total, i)), F.lit(10)))


def mod97(country: Column, check: Column, account: Column) -> Column:
    """The remainder by which an IBAN (in capitals, without spaces) is validated: 1."""

    def add(moved: Column, rest: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return let(F.concat(account, country, check), lambda m: F.aggregate(F.sequence(F.lit(1), F.length(m)), F.lit(0), lambda rest, i: add(m, rest, i)))


def email(m: Column, key: str) -> Column:
    local = F.concat(F.substring_index(m, "@", 1), F.lit("@"))
    return F.concat(refilled(local, permuted(F.lower(local), key), r"\s\S"), F.substring_index(m, "@", -1))


def secret(m: Column, key: str) -> Column:
    new = permuted(F.lower(m), key, hexadecimal=True)

    def mixed(new: Column) -> Column:
        return F.array_join(F.zip_with(F.split(m, ""), F.split(new, ""), lambda old, c: F.when(old.between("A", "F"), F.upper(c)).otherwise(c)), "")

    capitals = m.rlike("[A-F]")
    return let(new, lambda x: F.when(capitals & m.rlike("[a-f]"), mixed(x)).when(capitals, F.upper(x)).otherwise(x))


def iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

    def whole(new: Column) -> Column:
        check = F.lpad((98 - mod97(country, F.lit("00"), new)).cast("string"), 2, "0")
        return refilled(m, F.concat(country, check, new), "0-9A-Z")

    return let(F.upper(permuted(F.lower(account), key)), whole)


def is_iban(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return m.rlike(f"^{PATTERNS['iban']}$") & (mod97(F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, F.lit(5), F.length(plain))) == 1)


#: 1900-01-01 to 2099-12-31 are 73049 days, which is 17 * 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def fields(m: Column) -> Column:
    """The three numbers of a date as they are written."""
    return F.split(m, "[-./]")


def month_first(m: Column) -> Column:
    """Whether a date before its year has a month and then a day: only if it can't be read the other way."""
    return ~year_first(m) & (fields(m)[1].cast("int") > 12)


def year_first(m: Column) -> Column:
    return m.rlike("^[0-9]{4}")


def day(m: Column) -> Column:
    """The day that a date names, null if the calendar has none."""
    x = F.transform(fields(m), lambda n: F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0")))
    iso = F.when(year_first(m), F.concat_ws("-", x[0], x[1], x[2])).when(month_first(m), F.concat_ws("-", x[2], x[0], x[1])).otherwise(F.concat_ws("-", x[2], x[1], x[0]))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


#: Steps at most to a day of the same part of a month; each one gets there in two of five cases at least.
WALK = 128


def date(m: Column, key: str) -> Column:
    """The pseudonym of a date in the order in which it is written.

    Days up to the 12th are permuted among themselves and so are the later ones, whatever the order: the
    permutation of all days is walked on until it gets to a day of the same part. So one day has one
    pseudonym in all orders, and a month and a day can never be taken for a day and a month.
    """
    first = F.lit(FIRST_DAY).cast("date")

    def moved(d: Column) -> Column:
        n = F.datediff(d, first)
        pair = permuted_pair(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, key)
        return let(pair, lambda p: F.date_add(first, (p["x"] * DAYS[1] + p["y"]).cast("int")))

    def late(d: Column) -> Column:
        return F.dayofmonth(d) > 12

    def walked(d: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(d), lambda x, _: F.when(late(x) == late(d), x).otherwise(moved(x)))

    return let(day(m), lambda d: let(walked(d), lambda new: _written(m, new)))


def _written(m: Column, new: Column) -> Column:
    """The day in the order and with the separators of `m`; numbers that it writes with one digit have no leading zeros."""
    x, year = fields(m), F.date_format(new, "yyyy")

    def two(k: int, number: Column) -> Column:
        return F.when(F.length(x[k]) == 2, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))

    def joined(a: Column, b: Column, c: Column) -> Column:
        at = F.length(x[0]) + 1
        return F.concat(a, F.substr(m, at, F.lit(1)), b, F.substr(m, at + F.length(x[1]) + 1, F.lit(1)), c)

    month, dom = F.month(new), F.dayofmonth(new)
    return F.when(year_first(m), joined(year, two(1, month), two(2, dom))).when(month_first(m), joined(two(0, month), two(1, dom), year)).otherwise(joined(two(0, dom), two(1, month), year))


def ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, key)
    return let(pair, lambda p: F.concat_ws(".", F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256))


def ssn(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("int")
    x = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + F.substring(m, 5, 2).cast("int") - 1
    return let(permuted_pair(x, F.substring(m, 8, 4).cast("int") - 1, 898 * 99, 9999, key), _ssn)


def _ssn(p: Column) -> Column:
    index = F.floor(p["x"] / 99)
    return F.concat_ws("-", F.lpad(F.when(index > 664, index + 2).otherwise(index + 1).cast("string"), 3, "0"), F.lpad((p["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["y"] + 1).cast("string"), 4, "0"))


def card(m: Column, key: str) -> Column:
    d = digits_of(m)
    return let(permuted(F.substring(d, F.lit(1), F.length(d) - 1), key), lambda new: refilled(m, F.concat(new, luhn(new).cast("string")), "0-9"))


def is_card(m: Column) -> Column:
    d = digits_of(m)
    return m.rlike(f"^{PATTERNS['card']}$") & (luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1).cast("int"))


def phone(m: Column, key: str) -> Column:
    """A country code ends at the first separator; where there is none, it has one digit at least."""
    code = F.when(m.rlike(r"^\+[0-9]+$"), 1).when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+([0-9]+)", 1))).otherwise(0)

    def changed(d: Column) -> Column:
        own = F.least(F.lit(10), F.length(d) - code)
        return refilled(m, F.concat(F.substring(d, F.lit(1), F.length(d) - own), permuted(F.substring(d, F.length(d) - own + 1, own), key)), "0-9")

    return let(digits_of(m), changed)


REPLACE: dict[str, Callable[[Column, str], Column]] = {"email": email, "secret": secret, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "card": card, "phone": phone}


def kind_of(m: Column) -> Column:
    """The kind of a match; null if it is not valid."""
    out = F.lit(None).cast("string")
    for kind in reversed([k for k in PATTERNS if k != "iban"]):
        fits = m.contains("@") if kind == "email" else is_card(m) if kind == "card" else m.rlike(f"^(?:{PATTERNS[kind]})$")
        fits = fits & day(m).isNotNull() if kind == "date" else fits
        out = F.when(fits, F.lit(kind)).otherwise(out)
    return out


def replaced(text: Column, key: str) -> Column:
    """A struct of a text with its values but for IBANs replaced, and the kinds of these values in order; a match that is not valid stays."""

    def one(m: Column) -> Column:
        def chosen(kind: Column) -> Column:
            out = m
            for name, replace in REPLACE.items():
                if name != "iban":
                    out = F.when(kind == name, replace(m, f"{key}|{name}")).otherwise(out)
            return F.struct(out.alias("text"), kind.alias("kind"))

        return let(kind_of(m), chosen)

    def joined(found: Column) -> Column:
        pieces = F.zip_with(F.split(text, PATTERN, -1), found, lambda gap, m: F.array(gap, F.coalesce(m["text"], F.lit(""))))
        kinds = F.filter(F.transform(found, lambda m: m["kind"]), lambda k: k.isNotNull())
        return F.struct(F.array_join(F.flatten(pieces), "").alias("text"), kinds.alias("kinds"))

    def searched(matches: Column) -> Column:
        nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
        return F.when(F.size(matches) == 0, nothing).otherwise(let(F.transform(matches, one), joined))

    return let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), searched)


def around_ibans(text: Column, key: str) -> Column:
    """The text as parts, of which each second is the pseudonym of a valid IBAN."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS["iban"]), F.lit(0))

    def parts(matches: Column) -> Column:
        pairs = F.arrays_zip(F.split(text, PATTERNS["iban"], -1).alias("gap"), matches.alias("m"))

        def step(s: Column, x: Column) -> Column:
            open_text = F.concat(s["text"], x["gap"])
            valid = F.struct(F.concat(s["done"], F.array(open_text, iban(x["m"], f"{key}|iban"))).alias("done"), F.lit("").alias("text"))
            other = F.struct(s["done"].alias("done"), F.concat(open_text, F.coalesce(x["m"], F.lit(""))).alias("text"))
            return F.when(is_iban(x["m"]), valid).otherwise(other)

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"))
        return F.aggregate(pairs, start, step, lambda s: F.concat(s["done"], F.array(s["text"])))

    return F.when(text.rlike(IBAN_GATE), let(found, lambda m: F.when(F.size(m) == 0, F.array(text)).otherwise(parts(m)))).otherwise(F.array(text))


def pseudonymised(df: DataFrame, *, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The rows with their texts rewritten, and two columns more, `pii_kinds` (the kind of each value replaced, in order) and `pii_found` (their number).

    A null text stays null with no kinds, an empty one stays empty. What a pattern finds but
    validation refuses is left as it is, but for other values in it. Columns of those two names are
    replaced; all others pass through. Repeated rows are rewritten alike, and no rows give no rows.
    """
    names = [c for c in df.columns if c not in ("pii_kinds", "pii_found")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    text = F.col(f"`{text_col}`").cast("string")

    def part(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, replaced(p, key)).otherwise(F.struct(p.alias("text"), F.array(F.lit("iban")).alias("kinds")))

    parts = F.transform(around_ibans(text, key), part)
    whole = let(parts, lambda x: F.struct(F.array_join(F.transform(x, lambda p: p["text"]), "").alias("text"), F.flatten(F.transform(x, lambda p: p["kinds"])).alias("kinds")))
    some = df.select(row, F.when(text.rlike(GATE), whole).alias("new"))
    kinds = F.coalesce(F.col("new.kinds"), F.array().cast("array<string>"))
    rewritten = F.when(F.size(kinds) > 0, F.col("new.text")).otherwise(F.col("row")[text_col])
    columns = [rewritten.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    return some.select(*columns, kinds.alias("pii_kinds")).withColumn("pii_found", F.size("pii_kinds"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
