"""Format-preserving pseudonyms: numbers, dates and addresses are permuted within their own format.

Everything is a column expression: a text is split at the values found in it, each value is permuted by a
keyed Feistel network over the set of values of its format, and the parts are joined again. Equal values
get equal pseudonyms in every document, different values of a format get different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LETTERS, HEX_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MONTHS = [names.split() for names in (
    "january february march april may june july august september october november december",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "jan feb mar apr may jun jul aug sep oct nov dec", "jan feb mar apr may jun jul aug sept oct nov dec",
    "jan feb mär apr mai jun jul aug sep okt nov dez", "janv févr mars avr mai juin juil août sept oct nov déc",
    "ene feb mar abr may jun jul ago sep oct nov dic")]
ALNUM = "[0-9A-Za-z]"


def month_names(*months: int) -> str:
    found = {names[m - 1] for names in MONTHS for m in months}
    return "(?iu:" + "|".join(sorted(found, key=lambda name: (-len(name), name))) + ")"


def dates(form: str, numeric: bool) -> list[str]:
    """The patterns of a form of y, m and d that only calendar dates match."""
    year, leap = r"(?!0000)[0-9]{4}", r"(?!0000)(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
    return [form.format(y=y, m=number if numeric else month_names(*months), d=d) for number, months, d, y in (
        ("(?:0?[13578]|1[02])", (1, 3, 5, 7, 8, 10, 12), "(?:[12][0-9]|3[01]|0?[1-9])", year),
        ("(?:0?[469]|11)", (4, 6, 9, 11), "(?:[12][0-9]|30|0?[1-9])", year),
        ("0?2", (2,), "(?:1[0-9]|2[0-8]|0?[1-9])", year), ("0?2", (2,), "29", leap))]


NUMERIC_DATE = (rf"(?=[0-9]{{1,4}}(?<mark>[-/.])[0-9]{{1,2}}\k<mark>[0-9]{{1,4}}(?!{ALNUM}))(?:" + "|".join(
    d for form in ("{y}[-/.]{m}[-/.]{d}", "{m}[-/.]{d}[-/.]{y}", "{d}[-/.]{m}[-/.]{y}") for d in dates(form, True)) + ")")
NAMED_DATE = "|".join(d for form in (r"{d}(?:st|nd|rd|th|er|\.)?[ -](?:of |de )?{m}\.?,?(?: de)?[ -]{y}",
                                     r"{m}\.? {d}(?:st|nd|rd|th)?,? {y}") for d in dates(form, False))
NAMED_PARTS = r"^([0-9]{0,2})([^0-9]*?)(" + month_names(*range(1, 13)) + r")(?!\p{L})([^0-9]*)([0-9]{0,2})([^0-9]*)([0-9]{4})$"
PATTERNS = {
    # a local part of up to 64 characters, labels of up to 63, 253 in all: bounds keep the search linear and its stack flat
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "hex": r"(?=[0-9]{0,127}+[A-Fa-f])(?=[A-Fa-f]{0,127}+[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})",
    "date": f"{NUMERIC_DATE}|{NAMED_DATE}",
    "ip": rf"{OCTET}(?:\.{OCTET}){{3}}",
    "ssn": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}|\+[0-9]{8,15}"
             r"|\+[0-9]{1,3}[ .-]\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2}){4}|\+[0-9]{1,3}[ .-]\(?[0-9]{1,3}\)?(?:[ .-][0-9]{2,3}){3}"
             r"|\+[0-9]{1,3}[ .-]\(?[0-9]{1,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{1,3}[ .-]\(?[0-9]{2,5}\)?[ .-][0-9]{5,7}"
             r"|0[1-9](?:[ .-][0-9]{2}){4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}",
}


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def candidates(text: Column, kind: str) -> Column:
    """The longest match of a kind at every place of a text where one starts; they may overlap."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!{ALNUM})(?=((?:{PATTERNS[kind]})(?!{ALNUM})))"), F.lit(1)))


def valid_ibans(text: Column) -> Column:
    """Candidates and their beginnings that end with a group and validate."""

    def beginnings(value):
        groups = F.split(value, " ")
        return F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))

    return F.filter(F.array_distinct(F.flatten(F.transform(candidates(text, "iban"), beginnings))),
                    lambda v: v.rlike(f"^(?:{PATTERNS['iban']})$") & (account_rest(v) == 1))


def valid_cards(text: Column) -> Column:
    return F.filter(candidates(text, "card"), lambda v: F.call_function("luhn_check", only(v, "0-9")))


def pattern(text: Column) -> Column:
    """What is to be replaced in this text. Account and card numbers are listed one by one, the longest first:
    only those that validate, so a match never hides a value that starts within it."""

    def one_of(found, kind):
        longest = F.array_sort(found, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(
            a < b, -1).when(a > b, 1).otherwise(0))
        # the list is only tried where something of its form stands
        head = F.lit(f"(?={PATTERNS[kind]})(?:")
        return F.when(F.size(found) == 0, "(?!)").otherwise(F.concat(head, F.array_join(longest, "|"), F.lit(")")))

    listed = {"iban": let(valid_ibans(text), lambda found: one_of(found, "iban")),
              "card": let(valid_cards(text), lambda found: one_of(found, "card"))}
    parts = [F.lit(rf"(?<!{ALNUM})(?:")]
    for k, kind in enumerate(PATTERNS):
        parts += [F.lit("|" if k else ""), listed.get(kind, F.lit(PATTERNS[kind]))]
    return F.concat(*parts, F.lit(rf")(?!{ALNUM})"))


def digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def prf(key: str, *parts: Column) -> Column:
    """A keyed number below 2**48."""
    return F.conv(F.substring(digest(key, *parts), 1, 12), 16, 10).cast("long")


def rounds(left: Column, right: Column, step) -> Column:
    """Feistel rounds: (l, r) -> (r, step(l, r, round)); an even number of them, so the sides end in place."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")),
        lambda s, i: F.struct(s["r"].alias("l"), step(s["l"], s["r"], i).alias("r")))


def permute_number(n: Column, left: int, right: int, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 .. left * right - 1."""

    def step(a, b, i):
        return F.pmod(a + prf(key, tweak, i.cast("string"), b.cast("string")),
                      F.when(i % 2 == 0, F.lit(left)).otherwise(F.lit(right)).cast("long"))

    sides = let(n.cast("long"), lambda v: rounds(F.floor(v / right).cast("long"), F.pmod(v, F.lit(right).cast("long")), step))
    return let(sides, lambda s: s["l"] * right + s["r"])


def permute_string(text: Column, alphabet: str, key: str, tweak: Column) -> Column:
    """A keyed permutation of the strings of this length over the alphabet."""
    letters = F.lit(alphabet)

    def step(a, b, i):
        stream = digest(key, tweak, i.cast("string"), b)

        def turn(k):
            shift = F.conv(F.substr(stream, (k % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            at = F.call_function("instr", letters, F.substr(a, k + 1, F.lit(1)))
            return F.substr(letters, (at - 1 + shift) % len(alphabet) + 1, F.lit(1))

        return F.when(F.length(a) == 0, F.lit("")).otherwise(
            F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(a) - 1, F.lit(0))), turn), ""))

    def halves(t):
        half = F.floor(F.length(t) / 2).cast("int")
        return rounds(F.substr(t, F.lit(1), half), F.substr(t, half + 1, F.length(t)), step)

    return let(let(text, halves), lambda s: F.concat(s["l"], s["r"]))


def only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def refill(form: Column, digits: Column, letters: Column | None = None) -> Column:
    """The format with its digits, and its letters if given, replaced in order; letters keep their case."""

    def filled(given):
        form, digits, letters_ = given["form"], given["digits"], given["letters"]

        def one(i):
            c, head = F.substr(form, i, F.lit(1)), F.substr(form, F.lit(1), i)
            out = F.when(c.rlike("[0-9]"), F.substr(digits, F.length(only(head, "0-9")), F.lit(1)))
            if letters is not None:
                new = F.substr(letters_, F.length(only(head, "A-Za-z")), F.lit(1))
                out = out.when(c.rlike("[a-z]"), new).when(c.rlike("[A-Z]"), F.upper(new))
            return out.otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")

    spare = F.lit("") if letters is None else letters
    return let(F.struct(form.alias("form"), digits.alias("digits"), spare.alias("letters")), filled)


def email(value: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    letters = permute_string(F.lower(only(local, "A-Za-z")), LETTERS, key, F.concat(F.lit("email "), F.lower(domain)))
    digits = permute_string(only(local, "0-9"), "0123456789", key, F.concat(F.lit("email digits "), F.lower(domain)))
    return F.concat(refill(local, digits, letters), F.lit("@"), domain)


def mod97(text: Column) -> Column:
    """Remainder of an account number's characters, letters as 10 to 35."""
    def step(rest, c):
        digit = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(digit > 9, 100).otherwise(10) + digit) % 97

    return let(text, lambda t: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(t, i, F.lit(1))),
                                           F.lit(0), step))


def account_rest(value: Column) -> Column:
    return mod97(let(F.regexp_replace(value, " ", ""), lambda flat: F.concat(
        F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))))


def iban(value: Column, key: str) -> Column:
    def renumbered(flat):
        land, body = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), F.length(flat))
        new = refill(body, permute_string(only(body, "0-9"), "0123456789", key, F.concat(F.lit("iban "), land)))
        check = lambda n: F.lpad((98 - mod97(F.concat(n, land, F.lit("00")))).cast("string"), 2, "0")
        return let(new, lambda n: refill(value, only(F.concat(check(n), n), "0-9")))

    return F.when(account_rest(value) == 1, let(F.regexp_replace(value, " ", ""), renumbered))


def hexadecimal(value: Column, key: str) -> Column:
    new = permute_string(F.lower(value), HEX_DIGITS, key, F.lit("hex"))
    new = F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new)
    return F.when(value.rlike("[A-Fa-f]") & value.rlike("[0-9]"), new)


def date(value: Column, key: str) -> Column:
    """Permuted among the 146,097 days of the 400 years from 1600, 2000 and so on that hold the date.

    Leading zeros, the language and case of a month's name and the endings of a day stay as in the value.
    """
    return F.when(value.rlike(r"\p{L}{3}"), named_date(value, key)).otherwise(numeric_date(value, key))


def other_day(year: Column, month: Column, day: Column, key: str) -> Column:
    number = F.unix_date(F.make_date(year, month, day))
    since = number + 135140  # days since 1600-01-01
    return let(since, lambda n: let(F.floor(n / 146097).cast("long"), lambda era: F.date_from_unix_date((
        era * 146097 + permute_number(F.pmod(n, F.lit(146097)), 189, 773, key, F.concat(F.lit("date "), era.cast("string")))
        - 135140).cast("int"))))


def written(n: Column, zero: Column) -> Column:
    return F.when(zero, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def numeric_date(value: Column, key: str) -> Column:
    def parts(v):
        # the month stands first with slashes, unless only the other order is a date
        a, b = F.get(v, F.lit(0)).cast("int"), F.get(v, F.lit(1)).cast("int")
        month_first = F.when(value.contains("/"), b > last_day(v, a)).otherwise(a <= last_day(v, b))
        return F.when(F.length(F.get(v, F.lit(0))) == 4, F.array(F.lit(0), F.lit(1), F.lit(2))).when(
            month_first, F.array(F.lit(2), F.lit(1), F.lit(0))).otherwise(F.array(F.lit(2), F.lit(0), F.lit(1)))

    def last_day(v, month):
        """Of the month in the year that ends the value; 0 if there is no such month."""
        return let(F.get(v, F.lit(2)).cast("int"), lambda y: F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(
            (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).when(month.between(1, 12), 31).otherwise(0))

    def rewritten(v, at):
        # zeros where the value has one, and everywhere if no part of it is a single digit
        full = ~value.rlike("(?<![0-9])[1-9](?![0-9])")
        number = lambda k: F.get(v, F.get(at, F.lit(k))).cast("int")
        return let(other_day(number(0), number(1), number(2), key), lambda new: F.call_function("array_join", F.transform(v, lambda old, k: F.when(
            k == F.get(at, F.lit(0)), F.date_format(new, "yyyy")).otherwise(written(F.when(
                k == F.get(at, F.lit(1)), F.month(new)).otherwise(F.dayofmonth(new)), full | old.startswith("0")))),
            F.regexp_extract(value, "[-/.]", 0)))

    return let(F.split(value, "[-/.]"), lambda v: let(parts(v), lambda at: rewritten(v, at)))


def named_date(value: Column, key: str) -> Column:
    def piece(p, k):
        return F.get(p, F.lit(k))

    def rewritten(p, months):
        name, day_leads = piece(p, 2), piece(p, 0) != ""
        day = F.concat(piece(p, 0), piece(p, 4))
        at = F.array_position(months, F.lower(name)).cast("int")
        return let(other_day(piece(p, 6).cast("int"), at, day.cast("int"), key), lambda new: renamed(p, name, day_leads, day, months, new))

    def renamed(p, name, day_leads, day, months, new):
        n = F.dayofmonth(new)
        th = F.when(n.isin(1, 21, 31), "st").when(n.isin(2, 22), "nd").when(n.isin(3, 23), "rd").otherwise("th")

        def ending(text):
            rest = F.substr(text, F.lit(3), F.length(text))
            return F.when(text.rlike("^(?:st|nd|rd|th)"), F.concat(th, rest)).when(text.startswith("er") & (n > 1), rest).otherwise(text)

        month = let(F.get(months, F.month(new) - 1), lambda m: F.when(name == F.lower(name), m).when(
            name == F.upper(name), F.upper(m)).otherwise(F.initcap(m)))
        day, year = written(n, day.startswith("0")), F.date_format(new, "yyyy")
        return F.when(day_leads, F.concat(day, ending(piece(p, 1)), month, *(piece(p, k) for k in (3, 4, 5)), year)).otherwise(
            F.concat(piece(p, 1), month, piece(p, 3), day, ending(piece(p, 5)), year))

    lists = F.array(*(F.array(*map(F.lit, names)) for names in MONTHS))
    return let(F.array(*(F.regexp_extract(value, NAMED_PARTS, k) for k in range(1, 8))), lambda p: let(
        F.get(F.filter(lists, lambda names: F.array_contains(names, F.lower(piece(p, 2)))), F.lit(0)), lambda months: rewritten(p, months)))


def ip(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    return let(permute_number(number, 65536, 65536, key, F.lit("ip")), lambda new: F.concat_ws(
        ".", *(F.pmod(F.floor(new / 256 ** k), F.lit(256)).cast("string") for k in (3, 2, 1, 0))))


def ssn(value: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def written_out(new):
        place = F.floor(new / (99 * 9999))
        return F.format_string("%03d-%02d-%04d", place + F.when(place >= 665, 2).otherwise(1),
                               F.pmod(F.floor(new / 9999), F.lit(99)) + 1, F.pmod(new, F.lit(9999)) + 1)

    out = let(permute_number(number, 898, 99 * 9999, key, F.lit("ssn")), written_out)
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), out)


def phone(value: Column, key: str) -> Column:
    """The country code stays; the other digits are permuted."""
    code = F.when(value.startswith("+"), F.when(value.rlike(r"^\+[0-9]+$"), 1).otherwise(
        F.length(F.regexp_extract(value, r"^\+([0-9]+)", 1)))).otherwise(0)

    def renumbered(given):
        digits, code = given["digits"], given["code"]
        head = F.substr(digits, F.lit(1), code)
        new = permute_string(F.substr(digits, code + 1, F.length(digits)), "0123456789", key, F.concat(F.lit("phone "), head))
        return F.when(F.length(digits).between(8, 15), refill(value, F.concat(head, new)))

    return let(F.struct(only(value, "0-9").alias("digits"), code.alias("code")), renumbered)


def card(value: Column, key: str) -> Column:
    """Card numbers by their check digit; the first digit stays and the check digit is made anew."""
    def renumbered(digits):
        inner = F.substr(digits, F.lit(2), F.length(digits) - 2)
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permute_string(inner, "0123456789", key, F.lit("card")))
        check = lambda body: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))),
                                      lambda n: F.call_function("luhn_check", n))[0]
        return F.when(F.call_function("luhn_check", digits), refill(value, let(body, check)))

    return let(only(value, "0-9"), renumbered)


KINDS = {"email": email, "iban": iban, "hex": hexadecimal, "date": date, "ip": ip, "ssn": ssn, "phone": phone,
         "card": card}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a value found in a text."""
    return F.coalesce(*(F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), permute(value, key))
                        for kind, permute in KINDS.items()), value)


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """Replaces personal numbers, dates, addresses and keys in a text column by keyed pseudonyms.

    Found are e-mail addresses (a local part of at most 64 characters is permuted, the domain stays), account numbers (mod-97),
    hexadecimal keys, calendar dates (years of four digits; numbers with or without leading zeros, or months by
    their names or short names in English, German, French or Spanish), IPv4 addresses, social security numbers,
    phone numbers (international, ten digits as 3-3-4 or five pairs) and card numbers (check digit). What does not
    validate stays as it is and is searched for values that start within it; null and empty texts and all other
    columns stay too. `count_col` adds the number of values found. Rows are handled one by one: no shuffle.
    """
    text = F.col(text_col)
    asked = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    df = df.withColumn("townloom_pattern", F.when(asked, pattern(text)))
    wanted = F.col("townloom_pattern")
    found = F.when(asked, F.regexp_extract_all(text, wanted, F.lit(0)))
    new = F.array_join(F.zip_with(F.split(text, wanted, -1), F.transform(found, lambda v: pseudonym(v, key)),
                                  lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = df.withColumn(count_col, F.coalesce(F.size(found), F.lit(0)).cast("long")) if count_col else df
    return out.withColumn(text_col, F.when(asked, new).otherwise(text)).drop("townloom_pattern")
