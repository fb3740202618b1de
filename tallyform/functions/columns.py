"""Scalar functions as column expressions: text, dates, money, postcodes, e-mail, geometry. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ONES = ("Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen").split()
TENS = "Zero Ten Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()


def _spelled(n: int) -> str:
    parts = [f"{ONES[n // 100]} Hundred"] if n >= 100 else []
    n = n % 100
    if n >= 20:
        parts.append(TENS[n // 10])
        n = n % 10
    if n or not parts:
        parts.append(ONES[n])
    return " ".join(parts)


#: 0 to 999 in words: one constant array keeps the expressions small enough to be compiled.
SPELLED = [_spelled(n) for n in range(1000)]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, where repeating a large expression would outgrow compiled code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded_cents(x: Column) -> Column:
    """x to two decimals by its binary value, half to even: 2.675 is stored below 2.675, so 2.67.

    The fraction is taken apart into three integers of 26 bits, and hundredths of it are counted in integers. Below
    0.001 nothing is left to count; beyond 2**45, where cents are coarser than what a double tells apart, and for
    infinite ones and NaN the built-in rounding stands.
    """
    bits, unit = 26, float(1 << 26)
    limb = lambda rest, body: let(rest * unit, lambda y: let(F.floor(y), lambda n: body(n, y - n)))

    def settle(high: Column, tail: Column) -> Column:
        """Cents of high / 2**52, with tail / 2**78 more."""
        low = tail * 100
        total = high * 100 + F.shiftright(low, bits)
        more = low.bitwiseAND((1 << bits) - 1) > 0
        half, part = F.lit(1 << 51), total.bitwiseAND((1 << 52) - 1)
        cents = F.shiftright(total, 52)
        up = (part > half) | ((part == half) & (more | (cents % 2 == 1)))
        return cents + up.cast("long")

    def exact(a: Column) -> Column:
        whole = F.floor(a)
        cents = limb(a - whole, lambda f1, r1: limb(r1, lambda f2, r2: limb(r2, lambda f3, _: settle(f1 * (1 << bits) + f2, f3))))
        return F.when(a < 0.001, 0.0).otherwise((whole * 100 + cents) / F.lit(100.0))

    return let(F.abs(x), lambda a: F.when(a < float(1 << 45), F.signum(x) * exact(a)).otherwise(F.bround(x, 2)))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value, or null: a small dictionary as one CASE, which needs neither a join nor a shuffle."""
    return reduce(lambda case, kv: case.when(key == kv[0], kv[1]), table.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def normalized(text: Column) -> Column:
    """Lower case of what is a letter, a digit or one of + * @ -."""
    return F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9+*@-]", ""))


def trimmed(text: Column, chars: str = fixed.TRIM) -> Column:
    return F.btrim(text, F.lit(chars))


def title_word(text: Column) -> Column:
    return F.regexp_replace(trimmed(F.lower(text), fixed.TRIM_TITLE), r"^[0-9]+[.\-_)]", "")


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


# money and words


def _word(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, SPELLED)), n.cast("int"))


def integer_words(n: Column) -> Column:
    """0 to 999,999 in words; null beyond, where nothing else is defined."""
    thousands = F.concat_ws(" ", _word(F.floor(n / 1000)), F.lit("Thousand"), F.when(n % 1000 > 0, _word(n % 1000)))
    return F.when((n < 0) | (n > 999_999), None).when(n < 1000, _word(n)).otherwise(thousands)


def cents_words(cents: Column) -> Column:
    """Whole units in words, Point, both decimal digits."""
    return F.concat_ws(" ", integer_words(F.floor(cents / 100)), F.when(cents < 100_000_000, F.lit("Point")), _word(F.floor(cents / 10) % 10), _word(cents % 10))


def amount_words(amount: Column) -> Column:
    """Words of a decimal's text: decimals are cut or filled to two, what isn't digits counts as zero, empty stays empty."""
    text = F.trim(amount)
    whole = F.substring_index(text, ".", 1)
    rest = F.when(F.instr(text, ".") > 0, F.substring(text, F.length(whole) + 2, F.lit(1 << 30))).otherwise("")
    two = F.substring(F.rpad(rest, 2, "0"), 1, 2)
    digit = lambda at: F.coalesce(F.when(F.substring(two, at, 1).rlike("^[0-9]$"), F.substring(two, at, 1).cast("int")), F.lit(0))
    n = F.when(whole.rlike("^[0-9]{1,6}$"), whole.try_cast("int")).when(whole.rlike("^[0-9]+$"), F.lit(1_000_000)).otherwise(0)
    words = F.concat(integer_words(n), F.lit(" Point "), _word(digit(1)), F.lit(" "), _word(digit(2)))
    return F.when(text == "", "").otherwise(words)


def months_between_years(issue: Column, renewal: Column) -> Column:
    """Twelve for each calendar year between; months don't count."""
    return (F.year(renewal) - F.year(issue)) * 12


def installment_cents(contact: Column, months: Column) -> Column:
    """contact / months + 10.33 in cents, cut, in integers; null unless months > 0."""
    return F.when(months > 0, F.floor((contact.cast("decimal(20,0)") * 100 + months * 1033) / months)).cast("long")


def installment_text(contact: Column, months: Column) -> Column:
    """INVALID where no year lies between, empty where an input is missing or negative, else two decimals."""
    cents = installment_cents(contact, months)
    return F.when(months == 0, "INVALID").when(months.isNull() | (months < 0) | contact.isNull(), "").otherwise(F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))


def initials(*names: Column) -> Column:
    return F.concat(*[F.when(F.trim(x).rlike(r"^\p{L}"), F.upper(F.substring(F.trim(x), 1, 1))).otherwise("") for x in names])


# dates


def parsed_date(text: Column) -> Column:
    """Day/month/year of 1-2, 1-2 and 4 digits; null otherwise."""
    return F.when(F.trim(text).rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(F.trim(text), "d/M/yyyy"))


def clean_date(raw: Column) -> Column:
    """DD/MM/YYYY after the usual misread digits are put right; null unless a day of 1900 to 2100."""
    digits = F.translate(F.replace(raw, F.lit(" "), F.lit("")), "oOlI|SsBbZzgq", "0011155862299")
    day = F.try_to_date(F.regexp_replace(F.when(digits.rlike(r"^[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{4}$"), digits), r"[.\-]", "/"), "d/M/yyyy")
    return F.when(F.year(day).between(1900, 2100), F.date_format(day, "dd/MM/yyyy"))


# e-mail and postcodes

_LOCAL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"


def is_email(text: Column) -> Column:
    return text.rlike(f"^{_LOCAL}$")


def clean_email(raw: Column) -> Column:
    """struct(email, last_name): a name merged before the address is split off, a domain's lost dot is put back."""
    c = trimmed(raw)
    at = F.instr(c, "@")
    local = F.when(at > 1, F.substring(c, F.lit(1), at - 1)).otherwise("")
    joined = f"^([A-Za-z]{{2,}})_({_LOCAL})$"
    low, n = F.lower(local), F.length(local)
    sizes = F.when(F.floor(n / 2) + 1 >= 3, F.sequence(F.floor(n / 2).cast("int") + 1, F.lit(3), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    size = F.get(F.filter(sizes, lambda k: (n > k) & F.startswith(low, F.substring(low, -k, k))), 0)
    name = F.when(c.rlike(joined), F.regexp_extract(c, joined, 1)).when(size.isNotNull(), F.substring(local, F.lit(1), n - size)).otherwise("")
    mail = F.when(c.rlike(joined), F.regexp_extract(c, joined, 2)).when(size.isNotNull(), F.substring(c, n - size + 1, F.lit(1 << 30))).otherwise(c)
    for tail, dotted in ((r"(com|org|net|edu|gov)", ".$2"), ("couk", ".co.uk"), ("acuk", ".ac.uk"), ("ch", ".ch"), ("de", ".de"), ("fr", ".fr")):
        mail = F.regexp_replace(mail, f"(?i)@([a-zA-Z0-9-]+){tail}$", f"@$1{dotted}")
    mail = trimmed(mail)
    found = F.regexp_extract(mail, _LOCAL, 0)
    return F.struct(F.when((F.instr(mail, "@") > 1) & (found != ""), found).otherwise(mail).alias("email"), name.alias("last_name"))


POSTCODE = r"(?i)^(GIR\s*0AA|SAN\s*TA1|[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}|[A-Z]{1,2}[0-9]{1,2}[A-Z]?\s*[0-9][A-Z]{2})$"


def is_postcode(text: Column) -> Column:
    return F.trim(text).rlike(POSTCODE)


def _by_position(c: Column) -> Column:
    n = F.length(c)
    digit = F.translate(F.substring(c, n - 2, F.lit(1)), "ODQILZSB", "00011258")
    letters = F.translate(F.substring(c, n - 1, F.lit(2)), "0Q1825", "OOIBZS")
    outward = F.concat(F.translate(F.substring(c, 1, 1), "0Q1", "OOI"), F.translate(F.substring(c, 2, 1), "IL", "11"), F.translate(F.substring(c, F.lit(3), n - 5), "ILO", "110"))
    return F.when(n.between(5, 8), F.concat(F.substring(outward, F.lit(1), n - 3), F.lit(" "), digit, letters)).otherwise("")


def repaired_postcode(raw: Column) -> Column:
    """The code after misread characters are put right by position, if that makes it valid; the trimmed input otherwise."""
    compact = F.regexp_replace(F.translate(F.upper(trimmed(raw, fixed.TRIM_POSTCODE)), "][|!", "1111"), r"\s", "")
    return let(let(compact, _by_position), lambda made: F.when(made.rlike(POSTCODE), made).otherwise(F.trim(raw)))


def contact_digits(text: Column) -> Column:
    """Digits of a token that holds a currency amount of 2 to 5 digits; empty otherwise. A decimal point is lost."""
    return F.when(text.rlike(r"[£€$]\s*[0-9]{2,5}"), F.regexp_replace(text, "[^0-9]", "")).otherwise("")


# geometry


def hd_scale(width: Column, height: Column) -> Column:
    return F.bround(F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.lit(3600.0) / F.greatest(width, height))), 4)


def row_tolerance(median_height: Column) -> Column:
    return F.coalesce(F.least(F.greatest(F.rint(median_height * 0.6).cast("int"), F.lit(8)), F.lit(35)), F.lit(15))


def escaped_keys(text: Column) -> Column:
    """Text as a quoted literal of the keystroke script."""
    out = text
    for a, b in (("`", "``"), ('"', '`"'), ("\r", ""), ("\n", "`n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
