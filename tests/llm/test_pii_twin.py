"""Pseudonyms against a plain twin: values of every kind, planted in many contexts."""

import datetime as dt
import hashlib
import random

import pytest

from lithic.llm import pii, queries

KEY = "a key of tests"
SUB = pii.subkey(KEY)


def digest(text, name="sha256"):
    return hashlib.new(name, f"{SUB}{text}".encode()).hexdigest()


def permuted(x, u, v, kind, rounds=8):
    left, right = divmod(x, v)
    for i in range(rounds):
        if i % 2 == 0:
            left = (left + int(digest(f"|{kind}|{i}|{right}")[:15], 16)) % u
        else:
            right = (right + int(digest(f"|{kind}|{i}|{left}")[:15], 16)) % v
    return left * v + right


def digits_of(text):
    return "".join(c for c in text if c in "0123456789")


def refilled(shape, digits):
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in shape)


def moved_digits(d, kind):
    n = len(d) // 2
    return str(permuted(int(d), 10**n, 10 ** (len(d) - n), kind)).zfill(len(d))


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        k = int(c) * (1 + i % 2)
        total += k - 9 * (k > 9)
    return total % 10


def with_check(body):
    return body + str((10 - luhn(body + "0")) % 10)


def some_digits(r, n):
    return "".join(r.choices("0123456789", k=n))


def card(r):
    d = with_check(r.choice("3456") + some_digits(r, r.choice([12, 14, 14, 14, 17])))
    new = with_check(moved_digits(d[:-1], "card"))
    cut = {16: (4, 8, 12), 15: (4, 10)}.get(len(d), ()) if r.random() < 0.6 else ()
    sep = r.choice(" -")
    group = lambda x: sep.join(x[a:b] for a, b in zip((0, *cut), (*cut, len(x))))
    return group(d), group(new)


def phone(r):
    a, b, c = str(r.randint(200, 999)), some_digits(r, 3), some_digits(r, 4)
    sep = r.choice(" .-")
    shape = r.choice([f"{a}{sep}{b}{sep}{c}", f"({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+1{sep}{a}{sep}{b}{sep}{c}", f"020 {b}7 {c}", f"01{b} {c}12", f"+{r.randint(200, 999)}{b}{c}"])
    d = digits_of(shape)
    return shape, refilled(shape, d[:-10] + moved_digits(d[-10:], "phone"))


def spaced_phone(r):
    shape = r.choice(["+44 20 7{} {}", "+33 1 4{} {} 12", "+49 (0)30 {} {}", "+91-98{}-{}1"]).format(some_digits(r, 3), some_digits(r, 4))
    d = digits_of(shape)
    return shape, refilled(shape, d[:-10] + moved_digits(d[-10:], "phone"))


def social(r):
    area, group, serial = r.choice([*range(1, 666), *range(667, 900)]), r.randint(1, 99), r.randint(1, 9999)
    x = permuted(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "social")
    q, s = divmod(x, 9999)
    a, g = divmod(q, 99)
    shape = f"{area:03d}-{group:02d}-{serial:04d}".replace("-", r.choice("- "))
    return shape, refilled(shape, f"{a + 1 + (a > 664):03d}{g + 1:02d}{s + 1:04d}")


def date(r):
    first = dt.date(1900, 1, 1)
    n = r.choice([0, 73048, 72900 + r.randrange(149), r.randrange(73049)])
    new = first + dt.timedelta(permuted(n, 17, 4297, "date", 16))
    day = first + dt.timedelta(n)
    sep = r.choice("./-")
    order = r.choice(["ymd", "dmy", "mdy"])
    read = order
    if order != "ymd":
        one, two = (day.day, day.month) if order == "dmy" else (day.month, day.day)
        read = "dmy" if one > 12 else "mdy" if two > 12 or sep == "/" else "dmy"
        if read != order:
            order = read
    short = r.random() < 0.3
    put = lambda x, short: sep.join({"y": str(x.year), "m": f"{x.month:d}" if short else f"{x.month:02d}", "d": f"{x.day:d}" if short else f"{x.day:02d}"}[k] for k in order)
    return put(day, short), put(new, short and min(day.day, day.month) < 10)


def address(r):
    x = r.getrandbits(32)
    text = lambda x: ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))
    return text(x), text(permuted(x, 1 << 16, 1 << 16, "address"))


def mail(r):
    v = r.choice(["o'brien.{}@mail.example.com", "x_{}+tag@example.org", "é{}@exämple.de", "a" * 90 + "{}@example.net"]).format(r.randrange(10**6))
    h = digest(f"|text|{v}", "sha512")
    return v, f"u{h[:12]}@{h[12:20]}.invalid"


def secret(r):
    v = "".join(r.choices("0123456789abcdef", k=r.choice([16, 32, 40, 64, 128]))) if r.random() < 0.7 else "AKIA" + "".join(r.choices("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=16))
    if v[:4] != "AKIA" and not (set(v) & set("abcdef") and set(v) & set("0123456789")):
        return secret(r)
    h = digest(f"|text|{v}", "sha512")
    if v[:4] == "AKIA":
        return v, "AKIA" + h[:16].upper()
    if r.random() < 0.5:
        v = v.upper()
        return v, digest(f"|text|{v}", "sha512")[: len(v)].upper()
    return v, h[: len(v)]


KINDS = {"card": card, "phone": phone, "spaced": spaced_phone, "social": social, "date": date, "address": address, "mail": mail, "secret": secret}
AROUND = ["{}", "word {}", "{} word", "({})", '"{}"', "'{}'", "is:{}", "is={}", "{}, and", "{}. Next", "{}; {}", "<b>{}</b>", "é {} ñ", "\n{}\n", "\t{}\t", "| {} |", "[{}]", "so {}?", "*{}*", "a {} b {} c"]
DIGITS = ["7 {}", "12 {}", "id 10023 {}", "{} 12/25", "{} 7"]


def test_twin(spark):
    r, rows = random.Random(17), []
    for kind, make in KINDS.items():
        around = AROUND + ([] if kind in ("spaced", "mail") else DIGITS)
        if kind in ("card", "phone"):
            around = [a for a in around if a not in ("7 {}", "12 {}", "{} 7", "id 10023 {}")]
        for _ in range(6):
            for a in around:
                v, new = make(r)
                if kind == "social" and " " in v and a in DIGITS[:3]:
                    continue
                rows.append((kind, a.replace("{}", v), a.replace("{}", new), a.count("{}")))
    got = pii.pseudonymize(spark.createDataFrame([(i, x[1]) for i, x in enumerate(rows)], "i long, text string"), KEY, count="n").orderBy("i").collect()
    bad = [(x, g.text, g.n) for x, g in zip(rows, got) if g.text != x[2]]
    assert not bad, bad[:5]
    assert [g.n for g in got] == [x[3] for x in rows]


PLAIN = ["v1.2.3 and 1.2.3.4.5", "3.14 or 1,234,567.89", "10:30 to 11:45", "2020-2021", "pages 100-200", "1/2 cup, 3/4", "in 1999, 2001 and 2020", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "2021-02-30", "31/04/2001", "13/13/2001", "1899-12-31", "2100-01-01", "4785380592391138", "555-1234", "a@b", "@name", "deadbeefdeadbeef", "DEADBEEFDEADBEEF", "99 bottles 12 1234", "1 2 3 4 5 6 7 8 9", "" ]


def test_plain_text_stays(spark):
    got = pii.pseudonymize(spark.createDataFrame([(t,) for t in PLAIN], "text string"), KEY, count="n").collect()
    assert [(r.text, r.n) for r in got] == [(t, 0) for t in PLAIN]


def test_days_are_permuted(spark):
    u, v = pii.DAY_SIDES
    assert u * v == (dt.date(2099, 12, 31) - dt.date(1900, 1, 1)).days + 1
    got = {r.y for r in spark.range(u * v).selectExpr(pii.feistel("id", str(u), str(v), "date", "'k'", pii.DAY_ROUNDS) + " AS y").collect()}
    assert got == set(range(u * v))


def test_key(spark):
    """It is needed, shows in no plan, and is the session's or a random one of the process."""
    df = spark.createDataFrame([("555-123-4567",)], "text string")
    with pytest.raises(ValueError):
        pii.pseudonymize(df, "")
    out = pii.pseudonymize(df, KEY)
    out.collect()
    qe = out._jdf.queryExecution()
    for shown in (qe.toString(), qe.executedPlan().toString(), qe.logical().toString(), qe.analyzed().treeString()):
        assert KEY not in shown and SUB not in shown
    assert len(queries.pseudonym_key(spark)) == 64 and queries.pseudonym_key(spark) == queries.pseudonym_key(spark)
    other = spark.newSession()
    other.conf.set(queries.KEY_SETTING, "mine")
    assert queries.pseudonym_key(other) == "mine"
