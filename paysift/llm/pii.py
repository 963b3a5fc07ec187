"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Candidates are found by one pattern and validated by kind; a valid value is replaced by a keyed
permutation of itself within its format, so that equal values get equal pseudonyms in every
document and different values different ones.  What fails its validation stays as it is.

The permutation is a Feistel network over the value's components: they are split in two halves,
and each round adds to the components of one half, modulo their radix, numbers drawn from a
keyed SHA-256 of the other half.  Each round can be undone, so no two values meet.

kind   | valid if                                       | components (kept as they are)
card   | 13 to 19 digits, spaced or not, Luhn sum        | all digits but the last, which is made to fit the sum
iban   | known shape, remainder 1 modulo 97              | letters and digits from the fifth (country; check digits made to fit)
ssn    | area, group and serial of the issued ranges     | area, group, serial
phone  | international or bracketed form                 | digits (country code, punctuation)
email  | address shape                                   | letters and digits (the last two labels)
ip     | four numbers up to 255                          | the four numbers
date   | a calendar day of 1800-01-01 and 145,999 days on | its day number: equal days stay equal in any of the formats
       | yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy; dd/mm/yyyy with a day over 12 is permuted within those (the year alone from
       | the 29th on; 29/02 stays)
secret | 16 or more letters and digits given to a key word | letters and digits (the key word)

A card is looked for in the whole run of digit groups: first in the shapes 4-4-4-4, 4-4-4-1, 4-6-5, 4-6-4, unbroken and
4-4-4-4-3 at any group, then as the run itself.  (In other spacing beside another number it stays: nearly every row of
numbers has some span with the right sum.)  An iban is the longest valid start of its groups.  ``undo`` can miss a value
beside other groups if the new digits give another span a right sum.

Defined cases: a null text stays null and has no values; repeated rows get the same result; a
text without values, so any without a digit or an @, is returned unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default key; pass your own, and keep it secret.
KEY = "documentation-key"
ROUNDS = 8
FIRST_DAY, N_DAYS, DAY_RADIX = "1800-01-01", 146_000, (400, 365)

SECRET_WORD = r"(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
PATTERNS = {
    "secret": SECRET_WORD + r"(?=[A-Za-z_\-]*[0-9])[0-9A-Za-z_\-]{16,}",
    "email": r"(?<![0-9A-Za-z._%+\-])[0-9A-Za-z_%+\-][0-9A-Za-z._%+\-]{0,63}@(?:[0-9A-Za-z\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{4}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z]|[.\-/][0-9])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: A separator before a value of another kind ends a run of groups.
NEXT = r"(?![ \-](?:" + "|".join(PATTERNS[k] for k in ("date", "ssn", "ip")) + "))"
#: What is searched for: of a card, the whole run of digits that it may stand in; of an iban, its groups and what looks like more.
SEARCHED = PATTERNS | {
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:" + NEXT + r" ?[0-9A-Z]{4}){2,7}(?:" + NEXT + r" ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?=(?:[0-9][ \-]?){12}[0-9])[0-9]++(?![A-Za-z])(?:" + NEXT + r"[ \-][0-9]++(?![A-Za-z]))*+"}
ANY = "|".join(f"(?:{p})" for p in SEARCHED.values())
#: Card shapes by their number of groups, in the order tried.
SHAPES = {4: "[0-9]{4}([ \\-][0-9]{4}){2}[ \\-]([0-9]{4}|[0-9])", 3: "[0-9]{4}[ \\-][0-9]{6}[ \\-][0-9]{4,5}", 1: "[0-9]{13,19}",
          5: "[0-9]{4}([ \\-][0-9]{4}){3}[ \\-][0-9]{3}"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw(key: str, kind: Column, t: Column, i: Column, other: Column) -> Column:
    """A 48-bit number from the key, the round, the place and the other half, as text."""
    told = F.concat_ws("|", F.lit(key), kind, t.cast("string"), i.cast("string"), other, F.lit(key))
    return F.conv(F.substring(F.sha2(told, 256), 1, 12), 16, 10).cast("long")


def feistel(values: Column, radices: Column, kind: Column, key: str, undo: bool = False) -> Column:
    """The keyed permutation of ``values`` (array<long>), each below its radix."""
    rounds = F.array(*[F.lit(t) for t in (range(ROUNDS, 0, -1) if undo else range(1, ROUNDS + 1))])

    def half(x: Column, radix: Column, other: Column, t: Column) -> Column:
        def drawn(told: Column) -> Column:
            return F.zip_with(x, F.transform(radix, lambda r, i: F.struct(r.alias("r"), (_draw(key, kind, t, i, told) % r).alias("d"))),
                              lambda v, y: F.pmod(v - y["d"] if undo else v + y["d"], y["r"]))
        return _let(F.array_join(other.cast("array<string>"), ","), drawn)

    def step(acc: Column, t: Column) -> Column:
        return F.when(t % 2 == 1, F.struct(half(acc["l"], acc["lr"], acc["r"], t).alias("l"), acc["r"].alias("r"), acc["lr"].alias("lr"), acc["rr"].alias("rr"))) \
            .otherwise(F.struct(acc["l"].alias("l"), half(acc["r"], acc["rr"], acc["l"], t).alias("r"), acc["lr"].alias("lr"), acc["rr"].alias("rr")))

    def network(x: Column) -> Column:
        h, n = F.floor(F.size(x["v"]) / 2).cast("int"), F.size(x["v"])
        start = F.struct(F.slice(x["v"], 1, h).alias("l"), F.slice(x["v"], h + 1, n - h).alias("r"),
                         F.slice(x["n"], 1, h).alias("lr"), F.slice(x["n"], h + 1, n - h).alias("rr"))
        return F.aggregate(rounds, start, step, lambda acc: F.concat(acc["l"], acc["r"]))

    return _let(F.struct(values.alias("v"), radices.alias("n")), network)


def permute_chars(part: Column, kind: Column, key: str, undo: bool = False) -> Column:
    """Letters and digits of ``part`` permuted within their kinds; hexadecimal stays so."""
    def coded(c: Column, letters: Column) -> Column:  # (number, radix, first letter), the radix 0 for what stays
        code = F.ascii(c)
        of = lambda first, radix: F.struct((code - first).cast("long").alias("v"), radix.cast("long").alias("n"), F.lit(first).alias("a"))
        return (F.when(code.between(48, 57), of(48, F.lit(10))).when(code.between(97, 122), of(97, letters))
                .when(code.between(65, 90), of(65, letters)).otherwise(of(0, F.lit(0))))

    def rebuilt(x: Column) -> Column:  # chars, codes
        def joined(v: Column) -> Column:
            put = F.aggregate(x["codes"], F.struct(F.lit("").alias("s"), F.lit(0).alias("i"), F.lit(1).alias("at")), lambda acc, c: F.struct(
                F.concat(acc["s"], F.when(c["n"] > 0, F.char(c["a"] + F.get(v, acc["i"]))).otherwise(F.get(x["chars"], acc["at"] - 1))).alias("s"),
                (acc["i"] + (c["n"] > 0).cast("int")).alias("i"), (acc["at"] + 1).alias("at")))
            return put["s"]
        return _let(F.filter(x["codes"], lambda c: c["n"] > 0), lambda moved: _let(
            feistel(F.transform(moved, lambda c: c["v"]), F.transform(moved, lambda c: c["n"]), kind, key, undo), joined))

    def hexed(p: Column) -> Column:
        letters = F.when(p.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(6)).otherwise(F.lit(26))
        return _let(F.struct(F.split(p, "").alias("chars"), letters.alias("n")), lambda x: _let(
            F.struct(x["chars"].alias("chars"), F.transform(x["chars"], lambda c: coded(c, x["n"])).alias("codes")), rebuilt))

    return _let(part, hexed)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    chars = F.reverse(F.split(digits, ""))
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.transform(chars, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, d: a + d) % 10


def mod97(text: Column) -> Column:
    """A string of digits and capitals (as 10 to 35) as a number modulo 97."""
    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), (acc * 100 + letter) % 97).otherwise((acc * 10 + F.when(c.rlike("[0-9]"), c).cast("int")) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _only(m: Column, chars: str) -> Column:
    return F.regexp_replace(m, f"[^{chars}]", "")


def _is(m: Column, kind: str) -> Column:
    return m.rlike(f"^(?:{PATTERNS[kind]})$")


def _written_value(m: Column, key: str, undo: bool) -> Column:
    """(kind, new text) of a secret, email, iban, phone or card, whose letters and digits are
    permuted between a front and a back that stay; null for anything else."""
    def split(kind: str, front: Column | str, back: Column | str) -> Column:
        front, back = (F.regexp_extract(m, x, 0) if isinstance(x, str) else x for x in (front, back))
        middle = lambda e: F.substr(m, F.length(e["a"]) + 1, F.length(m) - F.length(e["a"]) - F.length(e["b"]))
        return _let(F.struct(front.alias("a"), back.alias("b")), lambda e: F.struct(
            F.lit(kind).alias("kind"), e["a"].alias("front"), middle(e).alias("middle"), e["b"].alias("back")))

    iban_valid = mod97(F.concat(_only(F.substr(m, F.lit(5)), "0-9A-Z"), F.substring(m, 1, 4))) == 1
    parts = (F.when(_is(m, "secret"), split("secret", "^" + SECRET_WORD, "$"))
             .when(_is(m, "email"), split("email", "^", r"(?:@|\.)[0-9A-Za-z\-]+\.[A-Za-z]+$"))
             .when(_is(m, "iban"), F.when(iban_valid, split("iban", F.substring(m, 1, 4), "$")))
             .when(_is(m, "phone"), split("phone", r"^(?:\+[0-9]{1,3}(?=[ .\-(])|\+1)?", "$"))
             .when(_is(m, "card"), F.when(luhn_sum(_only(m, "0-9")) == 0, split("card", "^", F.right(m, F.lit(1))))))

    def made(x: Column) -> Column:
        country = F.substring(x["front"], 1, 2)
        check = lambda new: F.lpad((98 - mod97(F.concat(_only(new, "0-9A-Z"), country, F.lit("00")))).cast("string"), 2, "0")
        digit = lambda new: F.pmod(F.lit(10) - luhn_sum(F.concat(_only(new, "0-9"), F.lit("0"))), F.lit(10)).cast("string")
        text = lambda new: (F.when(x["kind"] == "iban", F.concat(country, check(new), new))
                            .when(x["kind"] == "card", F.concat(new, digit(new))).otherwise(F.concat(x["front"], new, x["back"])))
        return F.when(x.isNotNull(), _let(permute_chars(x["middle"], x["kind"], key, undo), lambda new: F.struct(x["kind"].alias("kind"), text(new).alias("text"))))

    return _let(parts, made)


def _numbers_value(m: Column, key: str, undo: bool) -> Column:
    """(kind, new text) of a date, ssn or ip, which are permuted as numbers; null for anything else."""
    longs = lambda *x: F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("long") for v in x])

    def parsed(x: Column) -> Column:
        a, b, c = (F.get(x, F.lit(i)) for i in range(3))
        iso, dots = m.contains("-"), m.contains(".")
        swapped = dots | (~iso & (a > 12))
        year, month, day = (F.when(iso, p).when(swapped, q).otherwise(r).cast("int") for p, q, r in ((a, c, c), (b, b, a), (c, a, b)))
        months = F.array(*[F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)])
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        real = year.between(1800, 2299) & month.between(1, 12) & (day >= 1) & (day <= F.get(months, month - 1) + F.when((month == 2) & leap, 1).otherwise(0))
        number = F.when(real, F.datediff(F.make_date(year, month, day), F.lit(FIRST_DAY).cast("date")))
        style = F.when(iso, "iso").when(dots, "dots").when(swapped, "dmy").otherwise("mdy")
        of = lambda kind, v, n, style: F.struct(F.lit(kind).alias("kind"), v.alias("v"), n.alias("n"), style.alias("style"))
        date = _let(number, lambda d: F.when(d < N_DAYS, of("date", longs(F.floor(d / DAY_RADIX[1]), d % DAY_RADIX[1]), longs(*DAY_RADIX), style)))
        # dd/mm must not become a day that reads as mm/dd: its day stays over 12; from the 29th on only the year moves
        slashed = (F.when(real & (year < 2200) & (day <= 28), of("date", longs(year - 1800, month - 1, day - 13), longs(400, 12, 16), style))
                   .when(real & (year < 2200) & (month != 2), of("date", longs(year - 1800), longs(400), style)))
        date = F.when(style == "dmy", slashed).otherwise(date)
        issued = (a > 0) & (a < 900) & (a != 666) & (b > 0) & (c > 0)
        # areas 1 to 665 and 667 to 899 are numbered from 0
        ssn = F.when(issued, of("ssn", longs(F.when(a > 666, a - 2).otherwise(a - 1), b - 1, c - 1), longs(898, 99, 9999), F.lit("")))
        ip = F.when(F.array_max(x) < 256, of("ip", x, longs(256, 256, 256, 256), F.lit("")))
        return F.when(_is(m, "date"), date).when(_is(m, "ssn"), ssn).when(_is(m, "ip"), ip)

    def text(x: Column, v: Column) -> Column:
        padded = lambda n, width: F.lpad(n.cast("string"), width, "0")
        a, b, c = (F.get(v, F.lit(i)) for i in range(3))
        ssn = F.concat_ws("-", padded(F.when(a >= 665, a + 2).otherwise(a + 1), 3), padded(b + 1, 2), padded(c + 1, 4))

        def date(d: Column) -> Column:
            two = lambda n: F.when(F.length(m) == 10, padded(n, 2)).otherwise(n.cast("string"))
            y, mo, da = padded(F.year(d), 4), two(F.month(d)), two(F.dayofmonth(d))
            return (F.when(x["style"] == "iso", F.concat_ws("-", y, mo, da)).when(x["style"] == "dots", F.concat_ws(".", da, mo, y))
                    .otherwise(F.concat_ws("/", mo, da, y)))

        old = F.split(m, "/")
        two = lambda n: F.when(F.length(m) == 10, padded(n, 2)).otherwise(n.cast("string"))
        slashed = F.concat_ws("/", F.when(F.size(v) == 3, two(c + 13)).otherwise(F.get(old, F.lit(0))),
                              F.when(F.size(v) == 3, two(b + 1)).otherwise(F.get(old, F.lit(1))), (a + 1800).cast("string"))

        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (a * DAY_RADIX[1] + b).cast("int"))
        return (F.when(x["style"] == "dmy", slashed).when(x["kind"] == "date", _let(day, date)).when(x["kind"] == "ssn", ssn)
                .otherwise(F.array_join(v.cast("array<string>"), ".")))

    def made(x: Column) -> Column:
        return F.when(x.isNotNull(), _let(feistel(x["v"], x["n"], x["kind"], key, undo), lambda v: F.struct(x["kind"].alias("kind"), text(x, v).alias("text"))))

    numeric = _is(m, "date") | _is(m, "ssn") | _is(m, "ip")
    return F.when(numeric, _let(_let(F.split(m, r"[^0-9]").cast("array<long>"), parsed), made))


def card_pieces(run: Column) -> Column:
    """``run`` in pieces, the cards of a known shape and with the right sum being pieces of their own; one
    piece if it has none."""
    def cut(tokens: Column) -> Column:  # each with the separator before it
        def at(i: Column) -> Column:  # the number of groups of the card that starts here, or 0
            n = F.lit(0)
            for size, shape in reversed(SHAPES.items()):
                told = F.ltrim(F.regexp_replace(F.array_join(F.slice(tokens, i + 1, F.lit(size)), ""), "^-", ""))
                n = F.when(told.rlike(f"^(?:{shape})$") & (luhn_sum(_only(told, "0-9")) == 0), size).otherwise(n)
            return n

        def step(acc: Column, i: Column) -> Column:
            def grown(n: Column) -> Column:
                value = F.array_join(F.slice(tokens, i + 1, F.greatest(n, F.lit(1))), "")
                lead = F.regexp_extract(value, r"^[ \-]?", 0)
                put = F.when(n > 0, F.array(lead, F.substr(value, F.length(lead) + 1))).otherwise(F.array(value))
                return F.struct(F.concat(acc["out"], put).alias("out"), (i + F.greatest(n, F.lit(1))).alias("next"), (acc["cards"] + (n > 0).cast("int")).alias("cards"))
            return F.when(i < acc["next"], acc).otherwise(_let(at(i), grown))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"), F.lit(0).alias("cards"))
        return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda acc: F.when(acc["cards"] > 0, acc["out"]).otherwise(F.array(run)))

    return _let(F.regexp_extract_all(run, F.lit(r"([ \-]?[^ \-]+)"), F.lit(1)), lambda t: F.when(F.size(t) > 0, cut(t)).otherwise(F.array(run)))


def iban_pieces(m: Column) -> Column:
    """The longest valid iban that ``m`` starts with, if any, and the pieces of the rest."""
    def cut(tokens: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), ""))
        valid = F.filter(starts, lambda x: _is(x, "iban") & (mod97(F.concat(_only(F.substr(x, F.lit(5)), "0-9A-Z"), F.substring(x, 1, 4))) == 1))
        return _let(F.coalesce(F.try_element_at(valid, F.lit(-1)), F.lit("")), lambda v: F.concat(F.array(v), card_pieces(F.substr(m, F.length(v) + 1))))
    return _let(F.regexp_extract_all(m, F.lit("( ?[^ ]+)"), F.lit(1)), cut)


def pieces(m: Column) -> Column:
    """A match as the values that it may be, and what stands between them."""
    return F.when(m.rlike("^[0-9][0-9 \\-]{12,}$") & ~_is(m, "date") & ~_is(m, "ssn"), card_pieces(m)).when(_is(m, "iban"), iban_pieces(m)).otherwise(F.array(m))


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """(kind, new text) of a match, or null if it isn't valid."""
    return F.coalesce(_numbers_value(m, key, undo), _written_value(m, key, undo))


def replaced(text: Column, key: str = KEY, undo: bool = False) -> Column:
    """A struct: the new ``text``, and the ``kinds`` of the values replaced, in order."""
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    gaps = F.split(text, ANY)

    def joined(ms: Column) -> Column:
        new = F.transform(ms, lambda m: F.transform(pieces(m), lambda p: F.struct(p.alias("old"), pseudonym(p, key, undo).alias("new"))))
        def both(ps: Column) -> Column:
            told = F.transform(ps, lambda x: F.array_join(F.transform(x, lambda p: F.coalesce(p["new"]["text"], p["old"])), ""))
            whole = F.array_join(F.flatten(F.zip_with(gaps, F.concat(told, F.array(F.lit(""))), lambda g, t: F.array(g, t))), "")
            kinds = F.filter(F.transform(F.flatten(ps), lambda p: p["new"]["kind"]), lambda k: k.isNotNull())
            return F.struct(whole.alias("text"), kinds.alias("kinds"))
        return _let(new, both)

    plain = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike("[0-9@]"), _let(found, lambda ms: F.when(F.size(ms) > 0, joined(ms)).otherwise(plain))).otherwise(plain)


def pseudonymized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """Per row: doc_id, text, n_values, and the kinds of values replaced."""
    r = docs.select(docs[id_col].alias("doc_id"), replaced(docs[text_col], key).alias("r"))
    return r.select("doc_id", F.col("r.text").alias("text"), F.size("r.kinds").alias("n_values"), F.col("r.kinds").alias("kinds"))


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced."""
    return docs.withColumn(text_col, replaced(docs[text_col], key)["text"])
