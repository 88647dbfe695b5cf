"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates are found by pattern, validated, and permuted within their format by a keyed Feistel network, so that
equal values get equal pseudonyms in all documents, different values different ones, and whoever has the key can undo
it. The network works on pairs (a, b) of Z_na x Z_nb: in each round one half is shifted, modulo its own size, by a keyed
SHA-256 of the other. A kind of value is given by a bijection between its valid values and such pairs:

* card: 13 to 19 digits with a right check digit; all but that are permuted, and it is worked out anew;
* phone: ten digits of the North American plan, area and exchange codes from 200 on; other numbers with ``+``: all
  digits but the country code;
* ssn: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999;
* ip: four octets from 0 to 255; a first octet of 1 to 223 stays within these, one of 0 or 224 to 255 (multicast,
  reserved) within those;
* date: days from 1900 to 2099 (yyyy-mm-dd, dd/mm/yyyy or mm/dd/yyyy as it is valid, dd.mm.yyyy).

Signs between digits stay. E-mail addresses and secrets (access keys, and values of ``password``, ``token`` and the
like) have no such format: they get a keyed digest, as an address and as characters of their own kind and number.

Defined results: a null text stays null, an empty one empty; candidates that are not valid stay as they are; values may
not overlap, the leftmost pattern counts; all other columns (but one with the name of the counts), and repeated rows, are carried along as they are; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bendscape.llm.common import fresh, let

ROUNDS = 8
#: Patterns by kind. Each starts at a place that no longer match could start before, so no text is scanned twice.
PATTERNS = {
    # The second form gives labels back, for a full stop behind the address; Java recurses for each, and a name has 127 at most.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+|(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}+)",
    "secret": r"(?i:(?<![a-z0-9_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))[ \t]{0,3}[=:][ \t]{0,3}[\"']?[^\s\"']{6,}+",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "phone": r"(?<![\w+.-])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\w-])",
    "abroad": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[./-]\d)",
}
#: The country codes of two digits. Those that begin with 1 or 7 have one, all others three.
SHORT_CODES = "^(?:20|27|3[0-4]|36|39|4[0139]|4[4-8]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: 73,049 days from 1900-01-01 to 2099-12-31, as 17 times 4297.
DAYS = (17, 4297)


def _number(hexed: Column) -> Column:
    """Sixty bits of a hexadecimal digest."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def feistel(a: Column, b: Column, na: Column | int, nb: Column | int, tag: str, key: str, inverse: bool = False) -> Column:
    """The pair (a, b) of Z_na x Z_nb permuted (``inverse``: back), as a struct."""
    na, nb = (n if isinstance(n, Column) else F.lit(n).cast("long") for n in (na, nb))
    turns = F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])

    def one(acc: Column, r: Column) -> Column:
        sign = -1 if inverse else 1
        noise = lambda other: sign * _number(_digest(key, tag, r.cast("string"), other.cast("string")))
        moved_a = F.struct(F.pmod(acc["a"] + noise(acc["b"]) % na, na).alias("a"), acc["b"].alias("b"))
        moved_b = F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + noise(acc["a"]) % nb, nb).alias("b"))
        return F.when(r % 2 == 0, moved_a).otherwise(moved_b)

    return F.aggregate(turns, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), one)


def _pad(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0") if isinstance(width, int) else F.lpad(number.cast("string"), width, F.lit("0"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits, in order, exchanged for others; all other signs stay."""
    place = lambda i: F.length(_digits(F.substring(value, F.lit(1), i + 1)))
    return let(digits, lambda d: F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(d, place(i), F.lit(1))).otherwise(c)), ""))


def luhn(digits: Column) -> Column:
    """The sum whose last figure is 0 for a valid number, over the digits from the right."""
    each = lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))
    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), each), F.lit(0), lambda s, x: s + x)


def _halves(digits: Column, tag: str, key: str, inverse: bool) -> Column:
    """A string of up to 18 digits permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda m: F.pow(F.lit(10), m).cast("long")
    out = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n - u), power(u), power(n - u), tag, key, inverse)
    return let(out, lambda p: F.concat(_pad(p["a"], u), _pad(p["b"], n - u)))


def _card(value: Column, key: str, inverse: bool) -> Column:
    def permuted(d: Column) -> Column:
        body = _halves(F.substring(d, F.lit(1), F.length(d) - 1), "card", key, inverse)
        checked = let(body, lambda b: F.concat(b, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(luhn(d) % 10 == 0, _refill(value, checked)).otherwise(value)

    return let(_digits(value), permuted)


def _phone(value: Column, key: str, inverse: bool) -> Column:
    def permuted(d: Column) -> Column:
        number = F.substring(d, F.length(d) - 9, F.lit(10))
        part = lambda at, n: F.substring(number, at, n).cast("long")
        moved = feistel(part(1, 3) - 200, (part(4, 3) - 200) * 10_000 + part(7, 4), 800, 8_000_000, "phone", key, inverse)
        new = let(moved, lambda p: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _pad(p["a"] + 200, 3), _pad(F.floor(p["b"] / 10_000) + 200, 3), _pad(p["b"] % 10_000, 4)))
        return _refill(value, new)

    return let(_digits(value), permuted)


def _abroad(value: Column, key: str, inverse: bool) -> Column:
    def permuted(d: Column) -> Column:
        code = F.when(d.rlike("^[17]"), F.lit(1)).when(d.rlike(SHORT_CODES), F.lit(2)).otherwise(F.lit(3))
        rest = lambda n: _halves(F.substring(d, n + 1, F.length(d) - n), "abroad", key, inverse)
        new = let(code, lambda n: F.concat(F.substring(d, F.lit(1), n), rest(n)))
        return F.when(F.length(d).between(8, 19), _refill(value, new)).otherwise(value)

    return let(_digits(value), permuted)


def _ssn(value: Column, key: str, inverse: bool) -> Column:
    part = lambda at, n: F.substring(value, at, n).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    a = area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))
    moved = feistel(a, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key, inverse)
    new = let(moved, lambda p: F.concat(_pad(p["a"] + F.when(p["a"] >= 665, F.lit(2)).otherwise(F.lit(1)), 3), F.lit("-"), _pad(F.floor(p["b"] / 9999) + 1, 2), F.lit("-"), _pad(p["b"] % 9999 + 1, 4)))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new).otherwise(value)


def _ip(value: Column, key: str, inverse: bool) -> Column:
    def permuted(o: Column) -> Column:
        x = [F.get(o, F.lit(k)).cast("long") for k in range(4)]
        common = x[0].between(1, 223)
        first = F.when(common, x[0] - 1).when(x[0] == 0, x[0]).otherwise(x[0] - 223)
        moved = feistel(first * 256 + x[1], x[2] * 256 + x[3], F.when(common, 223 * 256).otherwise(33 * 256).cast("long"), 65536, "ip", key, inverse)
        octet = lambda n: F.when(common, n + 1).when(n == 0, n).otherwise(n + 223)
        new = let(moved, lambda p: F.concat_ws(".", *[c.cast("string") for c in (octet(F.floor(p["a"] / 256)), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))
        return F.when((x[0] < 256) & (x[1] < 256) & (x[2] < 256) & (x[3] < 256), new).otherwise(value)

    return let(F.split(value, r"\."), permuted)


def _date(value: Column, key: str, inverse: bool) -> Column:
    forms = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy")
    out = None
    for form in forms:
        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit("1900-01-01").cast("date"))
        moved = let(feistel(F.floor(day / DAYS[1]), day % DAYS[1], *DAYS, "date", key, inverse), lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int")))
        wide = {"d/M/yyyy": "dd/MM/yyyy", "M/d/yyyy": "MM/dd/yyyy", "d.M.yyyy": "dd.MM.yyyy"}.get(form, form)
        new = F.when(day.between(0, DAYS[0] * DAYS[1] - 1), F.date_format(moved, wide))
        out = new if out is None else F.coalesce(out, new)
    return F.coalesce(out, value)


def _email(value: Column, key: str, inverse: bool) -> Column:
    known = value.rlike(r"^user-[0-9a-f]{16}@private\.example$")
    return F.when(known, value).otherwise(F.concat(F.lit("user-"), F.substring(_digest(key, "email", F.lower(value)), 1, 16), F.lit("@private.example")))


def _stream(value: Column, tag: str, key: str, signs: str, length: Column | int) -> Column:
    """``length`` signs drawn from ``signs`` by a keyed digest of the value; long ones from several digests."""
    length = length if isinstance(length, Column) else F.lit(length)
    count = F.ceil(length / 32).cast("int")
    bytes_of = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: _digest(key, tag, i.cast("string"), value)), "")
    sign = lambda h: lambda i: F.substring(F.lit(signs), (F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("int") % len(signs)) + 1, F.lit(1))
    return let(bytes_of, lambda h: F.array_join(F.transform(F.sequence(F.lit(1), length), sign(h)), ""))


def _access(value: Column, key: str, inverse: bool) -> Column:
    return F.concat(F.substring(value, 1, 4), _stream(value, "access", key, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16))


def _secret(value: Column, key: str, inverse: bool) -> Column:
    head = F.regexp_extract(value, r"^[^=:]*[=:][ \t]{0,3}[\"']?", 0)
    secret = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head))
    signs = lambda s, of: _stream(s, "secret", key, of, F.length(s))
    return F.concat(head, let(secret, lambda s: F.when(s.rlike("^[0-9a-f]+$"), signs(s, "0123456789abcdef")).otherwise(signs(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))))


_KINDS = {"email": _email, "secret": _secret, "access": _access, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "card": _card, "ip": _ip, "date": _date}
#: Kinds whose pseudonyms can be undone.
REVERSIBLE = ("phone", "abroad", "ssn", "card", "ip", "date")


def pseudonym(value: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """One value of a kind exchanged for its pseudonym (``inverse``: back; of the reversible kinds)."""
    return _KINDS[kind](value, key, inverse)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS), counts: str | None = "n_private") -> DataFrame:
    """``docs`` with the private values of ``text`` exchanged, and how many of them were in column ``counts`` (None: no such column).

    Whoever knows ``key`` can undo numbers and dates, so there is no default.
    """
    if not key:
        raise ValueError("a key is needed")
    pattern = "|".join(PATTERNS[k] for k in kinds)
    t = F.col(text)

    def rebuilt(p: Column) -> Column:
        def exchanged(m: Column, i: Column) -> Column:
            # A value is matched anew with the sign before it and two behind, which is as far as the patterns look.
            gap, rest = F.get(p["gaps"], i), F.get(p["gaps"], i + 1)
            before = F.right(F.concat(F.lit("\n"), F.when(i > 0, F.get(p["found"], i - 1)).otherwise(F.lit("")), gap), F.lit(1))
            behind = F.left(F.concat(rest, F.coalesce(F.get(p["found"], i + 1), F.lit("")), F.lit("\n\n")), F.lit(2))

            def known(x: Column) -> Column:
                out = None
                for k in kinds:  # in the order of the alternatives, so the first that fits is the one that matched
                    fits = x.rlike(rf"^[\s\S](?:{PATTERNS[k]})[\s\S]{{2}}$")
                    out = F.when(fits, _KINDS[k](m, key, False)) if out is None else out.when(fits, _KINDS[k](m, key, False))
                return out.otherwise(m)

            return let(F.concat(before, m, behind), known)

        new = F.transform(p["found"], exchanged)
        return let(new, lambda n: F.struct(F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(n, i), F.lit("")))), "").alias("text"), F.size(F.filter(F.arrays_zip(p["found"].alias("a"), n.alias("b")), lambda z: z["a"] != z["b"])).cast("long").alias("n")))

    parts = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("gaps"))
    # Every private value has a digit, an @ or the word that names a secret.
    maybe = t.rlike(r"[0-9@]|[=:]")
    done = F.when(maybe, let(parts, rebuilt)).otherwise(F.struct(t.alias("text"), F.lit(0).cast("long").alias("n")))
    (d,) = fresh(docs.columns, "done")
    keep = [F.col(f"{d}.text").alias(c) if c == text else F.col(c) for c in docs.columns if c != counts]
    out = docs.withColumn(d, done)
    return out.select(*keep, *([F.coalesce(F.col(f"{d}.n"), F.lit(0)).cast("long").alias(counts)] if counts else []))
