"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers are validated (cards by their check digit, addresses by their octets,
dates by the calendar) and permuted under a key within their format: a card
becomes another number with a valid check digit, a date another date.  A Feistel
network is a bijection, so equal values get equal pseudonyms in all documents, and
different ones stay different.  E-mail names, keys and passwords, which have no
number format, get a keyed hash in letters of the same kind.

Round function: the head of sha2(key, round, half), as a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """As long as the country's IBANs are, so that no word after one is taken with it; what isn't so long, or of no known country, as far as it goes."""

    def fours(n: int) -> str:
        return rf"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    known = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}{fours(n - 4)}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
    return rf"(?=[A-Z]{{2}}\d{{2}})(?:{known}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"


# What is looked for, as Java patterns.  The order decides where two could start at one place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}",
    "secret": r"AKIA[A-Z2-7]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api_?key)[=:]\s?[\"']?[A-Za-z0-9]{8,64}|\"[0-9a-f]{32,64}\"",
    "iban": _iban_pattern(),
    "date": r"(?<!\d)(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)\d\d)(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(key: str, tweak: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A keyed permutation of structs (l, r), 0 <= l < left_size, 0 <= r < right_size (alternating unbalanced network).

    The rounds run in one fold, so that the expression doesn't double with each round.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    turns = F.array(*[F.lit(i) for i in range(ROUNDS)])

    def turn(s: Column, i: Column) -> Column:
        def noise(half: Column, modulus: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string")), 256)
            return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus

        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + noise(s["r"], left_size)) % left_size).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + noise(s["l"], right_size)) % right_size).alias("r"),
        )

    return F.aggregate(turns, start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("long")


def permuted_digits(key: str, tweak: str, digits: Column) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        k = (n / 2).cast("int")
        done = feistel(key, tweak, F.substr(d, F.lit(1), k), F.substr(d, k + 1, n - k), _power(k), _power(n - k))
        return _let(done, lambda p: F.concat(F.lpad(p["l"].cast("string"), k, "0"), F.lpad(p["r"].cast("string"), n - k, "0")))

    return _let(digits, halves)


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """The digit sum of the card check; doubled_from_right: 1 if the second digit from the right is doubled first, 0 if the last."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def worth(i: Column) -> Column:
            one = F.substr(d, i, F.lit(1)).cast("int")
            return F.when((n - i) % 2 == doubled_from_right, F.when(one > 4, one * 2 - 9).otherwise(one * 2)).otherwise(one)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + worth(i))

    return _let(digits, total)


def _refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced in order; all else stays."""

    def fill(d: Column) -> Column:
        step = F.aggregate(
            F.split(value, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(d, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        )
        return step["out"]

    return _let(digits, fill)


def _card(key: str, value: Column) -> Column:
    def changed(digits: Column) -> Column:
        body = permuted_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
        new = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits, 1) % 10 == 0, _refilled(value, new)).otherwise(value)

    return _let(F.regexp_replace(value, "[^0-9]", ""), changed)


def _digits(key: str, tweak: str, value: Column) -> Column:
    """All digits of value permuted."""
    return _refilled(value, permuted_digits(key, tweak, F.regexp_replace(value, "[^0-9]", "")))


def _phone(key: str, value: Column) -> Column:
    """The country code after + stays, up to the first separator, or one digit where there is none."""
    found = F.length(F.regexp_extract(value, r"^\+(\d{1,3})(?=[ .(-])", 1))
    code = F.when((found == 0) & value.startswith("+"), 1).otherwise(found)

    def changed(s: Column) -> Column:
        rest = F.substr(s["d"], s["n"] + 1, F.length(s["d"]))
        return _refilled(value, F.concat(F.substr(s["d"], F.lit(1), s["n"]), permuted_digits(key, "phone", rest)))

    return _let(F.struct(F.regexp_replace(value, "[^0-9]", "").alias("d"), code.alias("n")), changed)


def _ip(key: str, value: Column) -> Column:
    def changed(o: Column) -> Column:
        done = feistel(key, "ip", F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536))
        return _let(done, lambda p: F.concat_ws(".", *[x.cast("string") for x in ((p["l"] / 256).cast("long"), p["l"] % 256, (p["r"] / 256).cast("long"), p["r"] % 256)]))

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), changed)


def _date(key: str, value: Column) -> Column:
    """Dates of 1900 to 2099 permuted among themselves; leap days among leap days; no valid date: unchanged."""
    iso = value.rlike("^[0-9]{4}-")
    sep = F.substring(value, 3, 1)
    read = F.when(iso, F.try_to_date(value, "yyyy-MM-dd")).otherwise(F.try_to_date(F.regexp_replace(value, "[./]", "-"), "dd-MM-yyyy"))

    def moved(day: Column) -> Column:
        leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
        # Days of a year without its leap day: 0 to 364, by way of a year that has none.
        plain = F.dayofyear(F.make_date(F.lit(2001), F.month(day), F.when(leap, 28).otherwise(F.dayofmonth(day)))) - 1

        def common(p: Column) -> Column:
            d = F.date_add(F.lit("2001-01-01").cast("date"), p["r"].cast("int"))
            return F.make_date((p["l"] + 1900).cast("int"), F.month(d), F.dayofmonth(d))

        # The 49 leap days of those years, numbered, in seven times seven.
        nth = ((F.year(day) - 1904) / 4).cast("long")
        turned = _let(feistel(key, "leap", (nth / 7).cast("long"), nth % 7, F.lit(7), F.lit(7)), lambda p: p["l"] * 7 + p["r"])
        return F.when(leap, F.make_date((turned * 4 + 1904).cast("int"), F.lit(2), F.lit(29))).otherwise(_let(feistel(key, "date", F.year(day) - 1900, plain, F.lit(200), F.lit(365)), common))

    def written(new: Column) -> Column:
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat_ws("", F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy")))

    return F.when(read.isNull(), value).otherwise(_let(_let(read, moved), written))


def _word(key: str, tweak: str, value: Column, alphabet: str) -> Column:
    """A keyed hash as long as value, up to 64 characters, in 16 of the alphabet's letters."""
    return F.substr(F.translate(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), value), 256), "0123456789abcdef", alphabet), F.lit(1), F.length(value))


def _email(key: str, value: Column) -> Column:
    """The name is replaced (of 12 letters at least, so that names stay different), the domain stays in lower case."""
    low = F.lower(value)
    name, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    return F.concat(F.substring(F.translate(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), name), 256), "0123456789abcdef", "bcdfghjklmnprstv"), 1, 12), F.lit("@"), domain)


def _secret(key: str, value: Column) -> Column:
    head = F.regexp_extract(value, r"^(AKIA|[A-Za-z_]+[=:]\s?[\"']?|\")", 1)
    tail = F.when(value.endswith('"') & value.startswith('"'), '"').otherwise("")
    body = F.substr(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    return F.concat(head, F.when(head == "AKIA", _word(key, "aws", body, "ABCDEFGHIJKLMNOP")).otherwise(_word(key, "secret", body, "0123456789abcdef")), tail)


def _iban(key: str, value: Column) -> Column:
    """Country and length stay; account digits are permuted; check digits are set anew.  Not a valid IBAN: unchanged."""
    compact = F.regexp_replace(value, " ", "")

    def rest97(x: Column) -> Column:
        moved = F.concat(F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(4)))
        return F.aggregate(
            F.split(moved, ""),
            F.lit(0).cast("long"),
            lambda s, c: F.when(c == "", s).when(c.rlike("^[0-9]$"), (s * 10 + (F.ascii(c) - 48)) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
        )

    def changed(x: Column) -> Column:
        tail = F.substr(x, F.lit(5), F.length(x))
        digits = F.regexp_replace(tail, "[^0-9]", "")
        body = _refilled(tail, F.when(F.length(digits) >= 2, permuted_digits(key, "iban", digits)).otherwise(digits))
        head = F.substring(x, 1, 2)
        return _let(body, lambda b: F.concat(head, F.lpad((98 - rest97(F.concat(head, F.lit("00"), b))).cast("string"), 2, "0"), b))

    def spread(new: Column) -> Column:
        """Blanks go back to where they were."""
        return F.aggregate(
            F.split(value, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).when(c == "", s).otherwise(F.struct(F.concat(s["out"], F.substr(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))),
        )["out"]

    return _let(compact, lambda x: F.when(rest97(x) == 1, _let(changed(x), spread)).otherwise(value))


def kind_of(value: Column) -> Column:
    """The name of the first pattern that the whole value matches."""
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of one match; what doesn't validate stays as it is."""
    return _let(
        kind_of(value),
        lambda kind: F.when(kind == "email", _email(key, value))
        .when(kind == "secret", _secret(key, value))
        .when(kind == "iban", _iban(key, value))
        .when(kind == "date", _date(key, value))
        .when(kind == "ip", _ip(key, value))
        .when(kind == "ssn", _digits(key, "ssn", value))
        .when(kind == "card", _card(key, value))
        .when(kind == "phone", _phone(key, value))
        .otherwise(value),
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text", counts: bool = False) -> DataFrame:
    """docs with personal data in the text replaced; with counts, n_found and n_replaced (matches, and those that changed) are added.

    Null stays null, an empty text empty; all else in a text stays as it is, byte by byte.  Repeated rows stay repeated.
    Matches are cut out once, become pseudonyms in an array, and go back between the pieces around them.
    """
    c = F.col(text)
    if counts:
        docs = docs.drop("n_found", "n_replaced")
    held = "__matches"
    # A text without these can't hold any of the patterns, and they are far cheaper to look for.
    found = F.when(c.rlike("[0-9@=:]") | c.contains("AKIA"), F.regexp_extract_all(c, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn(held, F.coalesce(found, F.array().cast("array<string>")))
    fresh = F.transform(F.col(held), lambda v: pseudonym(key, v))
    marked = marked.withColumn("__fresh", F.when(F.size(held) > 0, fresh).otherwise(F.array().cast("array<string>")))
    woven = F.concat_ws("", F.flatten(F.zip_with(F.split(c, ANY, -1), F.col("__fresh"), lambda piece, v: F.array(piece, F.coalesce(v, F.lit(""))))))
    out = marked.withColumn(text, F.when(F.size(held) > 0, woven).otherwise(c))
    if counts:
        changed = F.aggregate(F.arrays_zip(F.col(held).alias("a"), F.col("__fresh").alias("b")), F.lit(0), lambda n, x: n + F.when(x["a"] != x["b"], 1).otherwise(0))
        out = out.withColumns({"n_found": F.size(held).cast("long"), "n_replaced": changed.cast("long")})
    return out.drop(held, "__fresh")
