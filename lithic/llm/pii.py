"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Numbers that pass their check (cards by the Luhn digit, addresses by octet range, social
security numbers by area, group and serial, phones by shape) and dates that exist are permuted
inside their own format by a keyed Feistel network: no two values of one format share a
pseudonym, equal values get equal ones in every document, and the result passes the same
check. Mail addresses and secrets, which are neither, get keyed digests of the same kind.
All other text stays as it is.

Patterns are one alternation, so a text is read twice: once cut at the matches and once
for them. The two arrays are then woven together. Digits next to a value must not hide it, so
only usual groupings of cards are in the alternation; unusual ones are looked for in the rest.

The key reaches the expressions as a column that a scalar subquery fills, so no plan shows it.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8

#: An apostrophe joins parts of a name, but a quotation mark before an address is not part of it.
MAIL = r"(?<![\p{L}\p{N}._%+-])(?<![\p{L}\p{N}]['’])[\p{L}\p{N}._%+-]++(?:['’][\p{L}\p{N}._%+-]++){0,8}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ADDRESS = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)"
#: Three, three and four digits, a country code or not; a plus and 8 to 15 digits; a trunk zero, an area and six to eight digits.
PHONE = (
    r"(?:(?<![\d+])\+\d{1,3}[ .-]?)?(?<!\d)(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{8,15}(?!\d)|(?<![\d+])\+\d(?:[ .()/-]{0,2}\d){7,14}(?!\d)"
    r"|(?<!\d)(?<!\d[.,:/-])0\d{1,4}[ -]\d{3,4}[ -]?\d{3,4}(?!\d|[.,:/-]\d)"
)
SOCIAL = r"(?<!\d)(?<!\d-)(?!000|666|9)\d{3}(?<s>[ -])(?!00)\d{2}\k<s>(?!0000)\d{4}(?!\d|-\d)"
_YEAR, _MONTH, _DAY = r"(?:19|20)\d{2}", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
#: Year first, or last after day and month in either order; one separator; zeros in front or not.
DATE = rf"(?<!\d)(?:{_YEAR}(?<a>[./-]){_MONTH}\k<a>{_DAY}|{_DAY}(?<b>[./-]){_MONTH}\k<b>{_YEAR}|{_MONTH}(?<c>[./-]){_DAY}\k<c>{_YEAR})(?!\d|\.\d)"
#: Unbroken, 4-6-4, 4-6-5, or a run of groups of four, in which the cards are found by their check.
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}-\d{6}-\d{4,5}|\d{4} \d{6} \d{4,5}|\d{4}(?:-\d{4}(?![./]?\d)){3,}(?:-\d{1,3}(?![./ -]?\d))?|\d{4}(?: \d{4}(?![./-]?\d)){3,}(?: \d{1,3}(?![./ -]?\d))?)(?!\d)"
#: Any grouping: looked for in what the other patterns leave.
LOOSE = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
SECRET = r"(?<![0-9A-Za-z])(?:(?=\d*[a-f])(?=[a-f]*\d)[0-9a-f]{16,128}|(?=\d*[A-F])(?=[A-F]*\d)[0-9A-F]{16,128}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])"

#: In order: where two could match at one place, the first counts.
KINDS = {"mail": MAIL, "secret": SECRET, "address": ADDRESS, "date": DATE, "phone": PHONE, "social": SOCIAL, "card": CARD}

#: Dates are permuted among the days of these years: 17 x 4297 of them.
FIRST_DAY, DAY_SIDES, DAY_ROUNDS = "1900-01-01", (17, 4297), 16
#: Social security numbers: 898 areas of 99 groups (the first half), 9999 serials (the second).
SOCIAL_SIDES = (898 * 99, 9999)

#: The column that holds the key in the expressions below.
KEY = "the_key"


def subkey(key: str) -> str:
    """What the expressions use in place of the key itself."""
    if not key:
        raise ValueError("pseudonyms need a key: with a known one anybody could undo them")
    return hmac.new(key.encode(), b"lithic pseudonyms 2", hashlib.sha256).hexdigest()


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound, so that `value` is written and computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _number_of(digest: str) -> str:
    return f"CAST(conv(substr({digest}, 1, 15), 16, 10) AS BIGINT)"


def feistel(x: str, u: str, v: str, kind: str, key: str = KEY, rounds: int = ROUNDS) -> str:
    """A keyed permutation of 0 .. u*v-1: halves of sizes u and v, changed in turn. `key` is a SQL expression."""

    def f(half: str, size: str) -> str:
        digest = f"sha2(concat({key}, '|{kind}|', i, '|', {half}), 256)"
        return f"{_number_of(digest)} % {size}"

    step = f"IF(i % 2 = 0, named_struct('l', (s.l + {f('s.r', u)}) % {u}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {f('s.l', v)}) % {v}))"
    return f"aggregate(sequence(0, {rounds - 1}), named_struct('l', CAST({x} div {v} AS BIGINT), 'r', CAST({x} % {v} AS BIGINT)), (s, i) -> {step}, s -> s.l * {v} + s.r)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _permuted_digits(digits: str, kind: str) -> str:
    """A digit string of any length up to 18, permuted among those of its length."""
    low, high = (f"CAST(rpad('1', {n} + 1, '0') AS BIGINT)" for n in ("CAST(length(d) div 2 AS INT)", "(length(d) - CAST(length(d) div 2 AS INT))"))
    moved = _let("v", high, _let("u", low, feistel("CAST(d AS BIGINT)", "u", "v", kind)))
    return _let("d", digits, f"lpad(CAST({moved} AS STRING), length(d), '0')")


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced, one by one, by those of `digits`."""
    place = f"length({_digits(f'substr({shape}, 1, k)')})"
    return _let("q", digits, f"array_join(transform(sequence(1, length({shape})), k -> IF(substr({shape}, k, 1) BETWEEN '0' AND '9', substr(q, {place}, 1), substr({shape}, k, 1))), '')")


def _luhn_sum(digits: str) -> str:
    """The Luhn sum of a digit string whose last digit is not doubled."""
    at = f"CAST(substr({digits}, length({digits}) - j, 1) AS INT)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, j) -> t + IF(j % 2 = 0, {at}, IF({at} > 4, {at} * 2 - 9, {at} * 2)))"


def _passes(digits: str) -> str:
    return f"length({digits}) BETWEEN 13 AND 19 AND {_luhn_sum(digits)} % 10 = 0"


def _card(m: str) -> str:
    """`m`, whose digits pass the check, with those of its pseudonym."""
    body = _let("b", _permuted_digits("left(c, length(c) - 1)", "card"), _let("z", "concat(b, '0')", f"concat(b, (10 - {_luhn_sum('z')} % 10) % 10)"))
    return _let("c", _digits(m), _refill(m, body))


def _cards(m: str) -> str:
    """`m` with the cards in it replaced: windows of four groups of four from the left, or else the whole."""
    window = f"substr({m}, 5 * g + 1, 19)"
    valid = _let("y", window, f"length(y) = 19 AND {_let('e', _digits('y'), _passes('e'))}")
    step = f"CASE WHEN a.s > 0 THEN named_struct('t', a.t, 's', a.s - 1) WHEN {valid} THEN named_struct('t', concat(a.t, {_let('y', window, _card('y'))}, substr({m}, 5 * g + 20, 1)), 's', 3) ELSE named_struct('t', concat(a.t, substr({m}, 5 * g + 1, 5)), 's', 0) END"
    runs = f"aggregate(sequence(0, CAST((length({m}) - 1) div 5 AS INT)), named_struct('t', '', 's', 0), (a, g) -> {step}, a -> a.t)"
    run = f"{m} rlike '^[0-9]{{4}}([ -][0-9]{{4}}){{3}}'"
    return _let("r", f"IF({run}, {runs}, {m})", f"IF(r = {m} AND {_let('e', _digits(m), _passes('e'))}, {_card(m)}, r)")


def _date(m: str) -> str:
    """`m` as the pseudonym of its day, in its order and with its separator, zeros in front unless `m` lacks one.

    Where day and month could each be either, a slash means the month first, others the day."""
    number = lambda k: f"CAST(q[{k}] AS INT)"
    order = f"CASE WHEN length(q[0]) = 4 THEN 'ymd' WHEN {number(0)} > 12 THEN 'dmy' WHEN {number(1)} > 12 OR contains({m}, '/') THEN 'mdy' ELSE 'dmy' END"
    iso = "CASE o WHEN 'ymd' THEN concat_ws('-', q[0], lpad(q[1], 2, '0'), lpad(q[2], 2, '0')) WHEN 'mdy' THEN concat_ws('-', q[2], lpad(q[0], 2, '0'), lpad(q[1], 2, '0')) ELSE concat_ws('-', q[2], lpad(q[1], 2, '0'), lpad(q[0], 2, '0')) END"
    u, v = DAY_SIDES
    moved = f"date_add(DATE '{FIRST_DAY}', CAST({feistel('n', str(u), str(v), 'date', rounds=DAY_ROUNDS)} AS INT))"
    short = "exists(q, x -> length(x) = 1)"
    two = lambda f: f"IF({short}, CAST({f}(w) AS STRING), lpad(CAST({f}(w) AS STRING), 2, '0'))"
    sep = f"IF(length(q[0]) = 4, substr({m}, 5, 1), substr({m}, length({m}) - 4, 1))"
    d, mo, y = two("day"), two("month"), "CAST(year(w) AS STRING)"
    written = f"CASE o WHEN 'ymd' THEN concat_ws({sep}, {y}, {mo}, {d}) WHEN 'mdy' THEN concat_ws({sep}, {mo}, {d}, {y}) ELSE concat_ws({sep}, {d}, {mo}, {y}) END"
    days = f"datediff(try_cast({iso} AS DATE), DATE '{FIRST_DAY}')"
    return _let("q", f"split({m}, '[./-]')", _let("o", order, _let("n", days, f"IF(n IS NULL, {m}, {_let('w', moved, written)})")))


def _social(m: str) -> str:
    u, v = SOCIAL_SIDES
    area = "CAST(left(p, 3) AS BIGINT)"
    number = f"(({area} - IF({area} > 666, 2, 1)) * 99 + CAST(substr(p, 4, 2) AS BIGINT) - 1) * {v} + CAST(right(p, 4) AS BIGINT) - 1"
    back = f"concat(lpad(CAST(x div {v} div 99 + IF(x div {v} div 99 > 664, 2, 1) AS STRING), 3, '0'), lpad(CAST(x div {v} % 99 + 1 AS STRING), 2, '0'), lpad(CAST(x % {v} + 1 AS STRING), 4, '0'))"
    return _let("p", _digits(m), _let("x", feistel(f"({number})", str(u), str(v), "social"), _refill(m, back)))


def pseudonym(m: str) -> str:
    """SQL for the pseudonym of the match `m`; the match itself where its check fails."""

    def is_(kind: str) -> str:
        return f"{m} rlike {_quote('^(?:' + KINDS[kind] + ')$')}"

    digest = f"sha2(concat({KEY}, '|text|', {m}), 512)"
    octet = [f"CAST(split({m}, '[.]')[{k}] AS BIGINT)" for k in range(4)]
    packed = f"({octet[0]} * 16777216 + {octet[1]} * 65536 + {octet[2]} * 256 + {octet[3]})"
    address = _let("a", feistel(packed, "65536", "65536", "address"), "concat_ws('.', a div 16777216, a div 65536 % 256, a div 256 % 256, a % 256)")
    phone = _refill(m, _let("p", _digits(m), f"concat(left(p, greatest(length(p) - 10, 0)), {_permuted_digits('right(p, 10)', 'phone')})"))
    secret = f"CASE WHEN {m} LIKE 'AKIA%' AND length({m}) = 20 THEN concat('AKIA', upper(left({digest}, 16))) WHEN {m} rlike '[a-f]' THEN left({digest}, length({m})) ELSE upper(left({digest}, length({m}))) END"
    return (
        f"CASE WHEN contains({m}, '@') THEN concat('u', left({digest}, 12), '@', substr({digest}, 13, 8), '.invalid') "
        f"WHEN {is_('secret')} THEN {secret} WHEN {is_('address')} THEN {address} WHEN {is_('date')} THEN {_date(m)} "
        f"WHEN {is_('phone')} THEN {phone} WHEN {is_('social')} THEN {_social(m)} ELSE {_cards(m)} END"
    )


def key_column(spark: SparkSession, key: str):
    """A column of the derived key, in a one-row table of which a plan shows the name only."""
    return spark.createDataFrame([(subkey(key),)], f"{KEY} string").scalar().alias(KEY)


def pseudonymize(docs: DataFrame, key: str, column: str = "text", count: str | None = None) -> DataFrame:
    """`docs` with personal data in `column` replaced; other columns, whatever their names, pass through.

    Null text stays null, empty text empty; texts are taken whole, however long. Rows are
    independent, so repeated rows give repeated results and an empty table an empty one; there
    are no ties. `count` names a column to add with the number of values replaced. An empty key
    is refused.
    """
    inner = "the_text"
    # A text without an at sign, and most have none, is read with a pattern that passes over most letters at once.
    every = _quote("|".join(KINDS.values()))
    others = _quote("(?=[0-9A-Fa-f+(])(?:" + "|".join(v for k, v in KINDS.items() if k != "mail") + ")")
    read = lambda f: f"IF(contains({inner}, '@'), {f.format(every)}, {f.format(others)})"
    # The whole row travels as one struct, so no column of the input can clash with these names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("the_row"), F.col(f"`{column}`").alias(inner), key_column(docs.sparkSession, key))
    rows = rows.withColumn("found", F.expr(read(f"regexp_extract_all({inner}, {{}}, 0)")))
    rows = rows.withColumn("new", F.expr(f"transform(found, m -> {pseudonym('m')})"))
    loose = _quote(LOOSE)
    # Only pieces that hold a valid card of unusual grouping are taken apart once more.
    rows = rows.withColumn("rest", F.expr(f"IF(size(found) > 0, {read(f"split({inner}, {{}}, -1)")}, array({inner}))"))
    again = _let("l", f"regexp_extract_all(p, {loose}, 0)", f"concat_ws('', flatten(zip_with(split(p, {loose}, -1), transform(l, x -> IF({_let('e', _digits('x'), _passes('e'))}, {_card('x')}, x)), (h, o) -> array(h, coalesce(o, '')))))")
    rows = rows.withColumn("rest_new", F.expr(f"transform(rest, p -> IF(p rlike {loose}, {again}, p))"))
    out = rows.withColumn("new_text", F.expr(f"IF({inner} IS NULL, NULL, concat_ws('', flatten(zip_with(rest_new, new, (a, b) -> array(a, coalesce(b, ''))))))"))
    usual = "size(filter(zip_with(found, new, (a, b) -> a != b), x -> x))"
    unusual = f"aggregate(rest, 0, (n, p) -> n + IF(p rlike {loose}, size(filter(regexp_extract_all(p, {loose}, 0), x -> {_let('e', _digits('x'), _passes('e'))})), 0))"
    columns = [(F.col("new_text") if c == column else F.col("the_row").getField(c)).alias(c) for c in docs.columns]
    return out.select(*columns, *([F.expr(f"IF({inner} IS NULL, 0, {usual} + {unusual})").alias(count)] if count else []))
