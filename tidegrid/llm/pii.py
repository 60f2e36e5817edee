"""Format-preserving Feistel pseudonyms for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Kinds in the order in which they are tried at a place of the text. Each begins where no longer run can, and is bounded.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([2-9][0-9]{2}\) ?|(?<![0-9.-])[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4})(?![0-9]|[.-][0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "key": r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{24,64})(?![A-Za-z0-9_])",
}
#: Days in 400 Gregorian years, which is 189 x 773: a date is permuted within its 400 years from EPOCH on.
EPOCH, DAYS_HIGH, DAYS_LOW = "0001-01-01", 189, 773
LAST_DAY = "9999-12-31"
#: Steps of a walk back into the valid numbers; each fails with a chance of about one in nine.
WALK = 40
#: Of dates by their separator: the forms in the order in which they are tried. A slash is month-first where that is a date.
DATE_FORMATS = {"-": ("yyyy-MM-dd",), ".": ("dd.MM.yyyy", "d.M.yyyy"), "/": ("MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy")}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _round(key: Column, kind: str, r: Column, value: Column) -> Column:
    hashed = F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def feistel(key: Column, kind: str, left: Column, right: Column, high: Column, low: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs in [0, high) x [0, low), by alternating additions."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), high.cast("long").alias("h"), low.cast("long").alias("w"))

    def step(a: Column, i: Column) -> Column:
        l = F.when(i % 2 == 0, (a["l"] + _round(key, kind, i, a["r"]) % a["h"]) % a["h"]).otherwise(a["l"])
        r = F.when(i % 2 == 1, (a["r"] + _round(key, kind, i, a["l"]) % a["w"]) % a["w"]).otherwise(a["r"])
        return F.struct(l.alias("l"), r.alias("r"), a["h"].alias("h"), a["w"].alias("w"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(key: Column, kind: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of a length from 2 to 36; shorter ones stay."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    # one evaluation, held in a one-element array
    out = F.transform(F.array(feistel(key, kind, F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half), ten(half), ten(n - half))), lambda x: F.concat(F.lpad(x["l"].cast("string"), half, "0"), F.lpad(x["r"].cast("string"), n - half, "0")))
    return F.when(n >= 2, out[0]).otherwise(digits)


def refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    isdigit = lambda c: c.between("0", "9") & (F.length(c) == 1)
    step = lambda a, c: F.struct(F.concat(a["out"], F.when(isdigit(c), F.substring(digits, a["k"], F.lit(1))).otherwise(c)).alias("out"), (a["k"] + F.when(isdigit(c), 1).otherwise(0)).alias("k"))
    return F.aggregate(F.split(form, ""), start, step, lambda a: a["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string of which the last digit is the check digit."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def mod97(code: Column) -> Column:
    """An account number's remainder: its first four characters go last, letters count 10 to 35."""
    moved = F.split(F.concat(F.substring(code, F.lit(5), F.length(code) - 4), F.substring(code, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def _valid_ssn(d: Column) -> Column:
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000")


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    middle = permute_digits(key, "card", F.substring(d, F.lit(2), F.length(d) - 2))
    body = F.transform(F.array(F.concat(F.substring(d, 1, 1), middle)), lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(luhn_sum(d) % 10 == 0, refill(m, body[0]))


def _iban(m: Column, key: Column) -> Column:
    code = F.replace(m, F.lit(" "), F.lit(""))
    bban = F.substring(code, F.lit(5), F.length(code) - 4)
    filled = F.transform(F.array(refill(bban, permute_digits(key, "iban", _digits(bban)))), lambda b: F.concat(F.substring(code, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(code, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), b))
    # in groups of four where it was
    shown = F.transform(filled, lambda x: F.when(F.contains(m, F.lit(" ")), F.trim(F.regexp_replace(x, "(.{4})", "$1 "))).otherwise(x))
    return F.when(mod97(code) == 1, shown[0])


def _phone(m: Column, key: Column) -> Column:
    """The digits after the country code, of which there are four at least, are permuted; the area code's first digit stays where it may not be 0 or 1."""
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?![0-9])", 0)
    country = F.when(F.startswith(m, F.lit("+")) & (country == ""), F.substring(m, 1, 3)).otherwise(country)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    new = F.transform(F.array(_digits(rest)), lambda d: F.when(F.startswith(m, F.lit("+")), refill(rest, permute_digits(key, "phone", d))).otherwise(refill(rest, _national(key, d))))
    return F.when(F.length(_digits(m)).between(7, 15), F.concat(country, new[0]))


def _national(key: Column, d: Column) -> Column:
    """Ten digits of which the first and the fourth are 2 to 9: permuted until they are so again."""
    good = lambda x: (F.substring(x, 1, 1) >= "2") & (F.substring(x, 4, 1) >= "2")
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), d, lambda a, i: F.when((i > 0) & good(a), a).otherwise(permute_digits(key, "phone", a)))


def _ipv4(m: Column, key: Column) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = F.transform(F.array(feistel(key, "ipv4", p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536))), lambda x: F.concat_ws(".", F.floor(x["l"] / 256).cast("string"), (x["l"] % 256).cast("string"), F.floor(x["r"] / 256).cast("string"), (x["r"] % 256).cast("string")))
    return F.when(F.forall(p, lambda x: x <= 255), out[0])


def _ssn(m: Column, key: Column) -> Column:
    d = _digits(m)
    step = lambda a, i: F.when((i > 0) & _valid_ssn(a), a).otherwise(permute_digits(key, "ssn", a))
    return F.when(_valid_ssn(d), refill(m, F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), d, step)))


def _date(m: Column, key: Column) -> Column:
    out = F.lit(None).cast("string")
    first, last = F.to_date(F.lit(EPOCH)), F.to_date(F.lit(LAST_DAY))
    cycle = DAYS_HIGH * DAYS_LOW
    end = F.datediff(last, first)

    def moved(n: Column) -> Column:
        """Permuted within the 400 years; the few days after the year 9999 lead on."""
        at = lambda x: F.transform(F.array(feistel(key, "date", F.floor(x % cycle / DAYS_LOW), x % cycle % DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW))), lambda p: F.floor(x / cycle) * cycle + p["l"] * DAYS_LOW + p["r"])[0]
        return F.aggregate(F.sequence(F.lit(0), F.lit(5)), n.cast("long"), lambda a, i: F.when((i > 0) & (a <= end), a).otherwise(at(a)))

    for mark, forms in DATE_FORMATS.items():
        here = F.lit(None).cast("string")
        for form in reversed(forms):
            day = F.to_date(F.try_to_timestamp(m, F.lit(form)))
            here = F.when(day.isNotNull() & (day >= first), _shown(F.array(F.datediff(day, first)), moved, first, form)).otherwise(here)
        out = F.when(F.contains(m, F.lit(mark)), here).otherwise(out)
    return out


def _shown(days: Column, moved, first: Column, form: str) -> Column:
    return F.transform(days, lambda n: F.date_format(F.date_add(first, moved(n).cast("int")), form))[0]


#: Alphabets within which characters of a text are permuted.
LETTERS, HEX = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"), ("0123456789abcdef", "ABCDEF")


def permute_chars(key: Column, kind: str, text: Column, hexa: bool = False) -> Column:
    """A keyed permutation of the strings of a form: letters stay letters of their case, digits digits, all else stays.

    A Feistel network over two halves of the string: a round shifts each character of one half within its
    alphabet, by a hash of the other half. Case takes no part in the hashes. With hexa the alphabet is that of hexadecimal
    digits, in lower case.
    """
    text = F.lower(text) if hexa else text
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def shifted(part: Column, other: Column, r: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), F.lower(other)), 256)

        def move(c: Column, i: Column, s: Column) -> Column:
            out = c
            for a in HEX[:1] if hexa else LETTERS:
                at = F.call_function("instr", F.lit(a), c)
                out = F.when(at > 0, F.substring(F.lit(a), ((at - 1 + F.pmod(F.xxhash64(s, i), F.lit(len(a)))) % len(a) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.transform(F.array(seed), lambda s: F.array_join(F.transform(F.split(part, ""), lambda c, i: move(c, i, s)), ""))[0]

    def step(a: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, shifted(a["l"], a["r"], i)).otherwise(a["l"]).alias("l"), F.when(i % 2 == 1, shifted(a["r"], a["l"], i)).otherwise(a["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.concat(a["l"], a["r"]))


def _email(m: Column, key: Column) -> Column:
    """All before the last dot is permuted."""
    last = F.length(m) - F.length(F.substring_index(m, ".", -1))
    return F.concat(permute_chars(key, "email", F.substring(m, F.lit(1), last - 1)), F.substring(m, last, F.length(m)))


def _ipv6(m: Column, key: Column) -> Column:
    return permute_chars(key, "ipv6", m, hexa=True)


def _key(m: Column, key: Column) -> Column:
    """The prefix, which names the issuer, stays."""
    head = F.regexp_extract(m, "^(?:AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_)", 0)
    return F.concat(head, permute_chars(key, "key", F.substring(m, F.length(head) + 1, F.length(m))))


KINDS = {"email": _email, "iban": _iban, "phone": _phone, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "ipv6": _ipv6, "card": _card, "key": _key}


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, found) for every row of docs; found lists (kind, n) by kind.

    Cards (Luhn), account numbers (remainder 97), phone numbers (digits, North American areas), social
    security numbers, IP addresses and dates are validated, and numbers that fail stay as they are. A
    valid value is permuted by a keyed Feistel network within its format: its separators, length,
    country or first digit stay, its check digits are made anew, and the result is valid again. E-mail
    addresses and access keys are permuted by characters within their alphabets. Equal values have equal
    pseudonyms in all documents, different values of a kind and form different ones. A date with slashes
    is read month-first where that is a date, else day-first. The key never appears in the result.

    Null texts stay null, with nothing found. Rows with a null id and repeated rows are kept. An empty
    table gives no rows. Other columns are ignored.
    """
    secret = F.sha2(F.lit(key), 256)
    every = "|".join(PATTERNS.values())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("hits", F.coalesce(F.regexp_extract_all("text", F.lit(every), F.lit(0)), F.array().cast("array<string>")))

    def replaced(m: Column) -> Column:
        kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, pattern in reversed(PATTERNS.items()):
            here = m.rlike(f"^(?:{pattern})$")
            kind, new = F.when(here, F.lit(name)).otherwise(kind), F.when(here, KINDS[name](m, secret)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"), m.alias("old"))

    rows = rows.withColumn("made", F.transform("hits", replaced))
    gaps = F.split("text", every, -1)
    whole = F.array_join(F.zip_with(gaps, F.concat(F.transform("made", lambda x: F.coalesce(x["new"], x["old"])), F.array(F.lit(""))), lambda g, x: F.concat(g, x)), "")
    valid = F.filter("made", lambda x: x["new"].isNotNull())
    counts = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.size(F.filter(valid, _of(k))).alias("n")) for k in PATTERNS]), lambda c: c["n"] > 0)
    none = F.filter(F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("n"))), lambda c: F.lit(False))
    return rows.select("id", F.when(F.size("hits") > 0, whole).otherwise(F.col("text")).alias("text"), F.when(F.size("hits") > 0, counts).otherwise(none).alias("found"))


def _of(kind: str):
    return lambda x: x["kind"] == kind
