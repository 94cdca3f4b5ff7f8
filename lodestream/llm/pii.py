"""Format-preserving pseudonyms for personal data, on DataFrame functions only.

Found and validated values are replaced by keyed pseudonyms of the same format. Numbers and dates go through a Feistel
network: the value is split in two parts, and ten rounds add a keyed hash of one part to the other, modulo that part's
range. That is a permutation of the values of a format, so equal values stay equal in every document, different ones
stay different, and who holds the key can invert it. Mail addresses and secrets, whose formats have no fixed size, get
keyed hashes in their own alphabet: 12 to 24 hex digits for the user of a mail address, as many as the secret has for a
secret. A secret behind a name and =, => or := (or, behind password, passwd, pwd and api_key, a colon) is found in any case
of the name, with or without blanks and quotes around name and value, which stay; quotes may hold blanks and end on the
line. Behind secret and token a colon counts where the value is quoted or has a digit and six characters at least, since
prose has these words as well; behind authorization and bearer, basic or token any value is one. If the secret is a value
of another kind it gets the pseudonym of that kind, so it stays linked to its other places. An upper-case hex key stays
upper-case, with the pseudonym of its lower-case form.

Validation: card numbers by their check digit (13 to 19 digits), IPv4 by octets up to 255, dates by the calendar,
1900-01-01 to 2099-12-31, as year-month-day with hyphens or as day, month and year with slashes or dots (month first only
where that is the one reading that is a date), telephone numbers by their grouping, SSN by its reserved ranges, host names
by the limits of DNS (labels of up to 63 characters, 127 of them). Pseudonyms of cards, dates, addresses and SSN pass the
same validation: each is a permutation of the valid values.

Patterns run on any text in time that grows with its length: what repeats without a bound is possessive and starts only
where such a run starts, and what nests is bounded.

Defined cases: a null text stays null with no values; an empty one stays empty; a text without values is returned
unchanged; repeated rows are treated alike; an empty table gives an empty table; extra columns, whatever their names, are
kept by ``pseudonymize_column``. Values are replaced wherever they stand in the text, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import fresh_name

ROUNDS = 10
#: The setting that holds the key of the pseudonyms, and the key of sessions without it, which protects nothing.
KEY_SETTING, DEMO_KEY = "spark.lodestream.pseudonym.key", "lodestream-demo-key"

#: The words before the value of an authorization header.
SCHEME = r"(?:(?i:bearer|basic|token)[ \t]++)"
#: What stands before a secret. The first letters spare most places the names.
NAMED = (
    r"""(?=[PpSsAaTt])(?:(?i:password|passwd|pwd|secret|api[_-]?key|token)["']?+[ \t]*+(?::=|=++>?+)[ \t]*+|(?i:password|passwd|pwd|api[_-]?key)["']?+[ \t]*+:(?!=)[ \t]*+"""
    r"""|(?i:secret|token)["']?+[ \t]*+:(?!=)[ \t]*+(?=["'][^"'\s]|(?=[^\s,;]{6})[^\s,;0-9]{0,200}+[0-9])|(?i:authorization)["']?+[ \t]*+[:=][ \t]*+["']?+"""
    rf"{SCHEME})"
)

#: Formats by kind. The order decides which one takes a place that two could take.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}+(?![\w-])",
    "awskey": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "password": rf"""(?<![A-Za-z0-9]){NAMED}(?!(?:""|'')(?![^\s,;]))(?:(?:"[^"\n]++"|'[^'\n]++')(?:[A-Za-z0-9][^\s,;]*)?|[^\s,;]+)""",
    "hexkey": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{40}(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "isodate": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "dmydate": r"(?<![0-9/.])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}(?![0-9/]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
#: The kinds that never start behind a letter or digit. They come first above; all others start with a digit, + or (.
WORDS = ("email", "awskey", "password", "hexkey")
#: All formats. What each kind asks of its start is asked once before them, so that most places in a text are left at once.
ANY = rf"(?<![A-Za-z0-9])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in WORDS)})|(?=[0-9+(])(?:{'|'.join(f'(?:{p})' for k, p in PATTERNS.items() if k not in WORDS)})"


def session_key(spark: SparkSession) -> str:
    """The key that the session's configuration holds. Pseudonyms stay linked as long as it stays the same.

    Only a session on one machine, as in tests, may do without the setting.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY_SETTING}: the built-in key is public, and who knows the key can invert the pseudonyms")
    return key or DEMO_KEY


def maybe(text: Column) -> Column:
    """A cheap test that spares most texts the patterns: true for any text in which one of them is found."""
    named = (text.contains("=") | text.contains(":")) & text.rlike(rf"(?<![A-Za-z0-9]){NAMED}")
    return text.contains("@") | text.contains("AKIA") | text.rlike(r"[0-9]\.?[0-9]") | named | text.rlike("[0-9A-Fa-f]{40}")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever loops the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash, as a long that is not negative."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """A keyed permutation of the pairs (left < a, right < b): a struct of left and right."""

    def step(s: Column, i: Column, given: Column) -> Column:
        sign = F.lit(-1 if inverse else 1)
        on_left = F.pmod(s["left"] + sign * F.pmod(keyed(key, given["tweak"], i, s["right"]), given["a"]), given["a"])
        on_right = F.pmod(s["right"] + sign * F.pmod(keyed(key, given["tweak"], i, s["left"]), given["b"]), given["b"])
        even = i % 2 == 0
        return F.struct(F.when(even, on_left).otherwise(s["left"]).alias("left"), F.when(even, s["right"]).otherwise(on_right).alias("right"))

    turns = list(range(rounds))[:: -1 if inverse else 1]
    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    fixed = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), tweak.alias("tweak"))
    return once(fixed, lambda given: F.aggregate(F.array(*map(F.lit, turns)), start, lambda s, i: step(s, i, given)))


def permute_digits(digits: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """A keyed permutation of the digit strings of one length (2 to 36 digits); shorter ones stay."""
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def permuted(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        out = feistel(F.substr(d, F.lit(1), u).cast("long"), F.substr(d, u + 1, n - u).cast("long"), ten(u), ten(n - u), key, F.concat_ws(":", tweak, n.cast("string")), inverse=inverse)
        joined = once(out, lambda s: F.concat(F.lpad(s["left"].cast("string"), u, "0"), F.lpad(s["right"].cast("string"), n - u, "0")))
        return F.when(n < 2, d).otherwise(joined)

    return once(digits, permuted)


def check_digit(digits: Column) -> Column:
    """The digit that makes a card number out of the digits before it."""
    doubled = lambda x, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(x, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    return once(digits, lambda x: F.pmod(-F.aggregate(doubled(x, F.length(x)), F.lit(0), lambda s, d: s + d % 10 + F.floor(d / 10).cast("int")), F.lit(10)).cast("string"))


def reshape(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by ``digits``."""

    def shaped(x: Column) -> Column:
        char, place = (lambda i: F.substr(x["value"], i, F.lit(1))), (lambda i: F.length(F.regexp_replace(F.substr(x["value"], F.lit(1), i), "[^0-9]", "")))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x["value"])), lambda i: F.when(char(i).rlike("[0-9]"), F.substr(x["digits"], place(i), F.lit(1))).otherwise(char(i))), "")

    return once(F.struct(value.alias("value"), digits.alias("digits")), shaped)


def _permute_date(x: Column, key: str) -> Column:
    """The date of a struct (day, form), permuted among the 73,049 = 17 x 4297 days from 1900-01-01 to 2099-12-31, in its form."""
    n = F.datediff(x["day"], F.lit("1900-01-01").cast("date")).cast("long")
    out = feistel(F.floor(n / 4297), n % 4297, F.lit(17), F.lit(4297), key, F.lit("date"))
    moved = lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["left"] * 4297 + s["right"]).cast("int"))
    return once(out, lambda s: F.call_function("date_format", moved(s), x["form"]))


def _permute_ssn(digits: Column, key: str) -> Column:
    """Nine digits, permuted among the valid numbers: 898 areas (1 to 899 without 666) times 99 groups of 9999."""
    area, rest = F.substr(digits, F.lit(1), F.lit(3)).cast("long"), (F.substr(digits, F.lit(4), F.lit(2)).cast("long") - 1) * 9999 + F.substr(digits, F.lit(6), F.lit(4)).cast("long") - 1
    out = feistel(area - F.when(area > 666, 2).otherwise(1), rest, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    put = lambda n, k: F.lpad(n.cast("long").cast("string"), k, "0")
    join = lambda s: F.concat(put(s["left"] + F.when(s["left"] >= 665, 2).otherwise(1), 3), put(F.floor(s["right"] / 9999) + 1, 2), put(s["right"] % 9999 + 1, 4))
    return once(out, join)


def _hexlike(key: str, kind: str, value: Column, n: Column) -> Column:
    return F.substr(F.concat(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), value), 256), F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind + "2"), value), 256)), F.lit(1), n)


def _secret(key: str, named: Column, n: Column) -> Column:
    """n hex digits: the keyed hash of a secret with its name, then hashes of that hash."""
    more = lambda first: F.transform(F.sequence(F.lit(1), F.floor((n - 1) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), i.cast("string"), first), 256))
    return once(_hexlike(key, "password", named, F.lit(64)), lambda first: F.when(n <= 64, F.substr(first, F.lit(1), n)).otherwise(F.substr(F.concat(first, F.array_join(more(first), "")), F.lit(1), n)))


def _opened(v: Column) -> Column:
    """A struct (head, inner, tail) of a match: the name, = and quotes around a secret, which are empty for other kinds."""
    secret = v.rlike(f"^(?:{PATTERNS['password']})$")
    head = F.when(secret, F.regexp_extract(v, f"^{NAMED}[\"']*", 0)).otherwise(F.lit(""))
    split = lambda h: F.struct(h.alias("head"), F.substr(v, F.length(h) + 1, F.length(v)).alias("rest"))
    tail = lambda x: F.when(x["head"].rlike(f"[\"']{SCHEME}?$"), F.regexp_extract(x["rest"], "(?<![\"'])[\"']++$", 0)).otherwise(F.lit(""))
    ended = F.transform(F.transform(F.array(head), split), lambda x: F.struct(x["head"].alias("head"), x["rest"].alias("rest"), tail(x).alias("tail")))
    return F.get(F.transform(ended, lambda x: F.struct(x["head"].alias("head"), F.substr(x["rest"], F.lit(1), F.length(x["rest"]) - F.length(x["tail"])).alias("inner"), x["tail"].alias("tail"))), F.lit(0))


def _replacement(x: Column, key: str) -> Column:
    """A struct (kind, value) for a match in its parts: a secret that is of no other kind gets a hash of its name and itself."""
    name = F.lower(F.regexp_extract(x["head"], "^[A-Za-z_]+", 0))
    secret = _secret(key, F.concat(name, F.lit("="), x["inner"]), F.length(x["inner"]))
    hidden = F.when((x["head"] != "") & (x["inner"] != "") & x["m"]["kind"].isNull(), F.struct(F.lit("password").alias("kind"), secret.alias("value"))).otherwise(x["m"])
    return once(hidden, lambda m: F.struct(m["kind"].alias("kind"), F.concat(x["head"], m["value"], x["tail"]).alias("value")))


def _pseudonym(v: Column, key: str) -> Column:
    """A struct (kind, value) for a value: its pseudonym, or kind null and the value itself where it doesn't validate."""
    return once(F.regexp_replace(v, "[^0-9]", ""), lambda digits: _by_kind(v, digits, key))


def _by_kind(v: Column, digits: Column, key: str) -> Column:
    n = F.length(digits)
    full = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    keep = F.struct(F.lit(None).cast("string").alias("kind"), v.alias("value"))
    put = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    user = F.substring_index(v, "@", 1)
    marks = F.regexp_extract(v, "^[._%+-]*", 0)  # what isn't part of a name stays
    mail = F.concat(marks, F.lit("u"), _hexlike(key, "email", F.lower(F.substr(v, F.length(marks) + 1, F.length(v))), F.least(F.greatest(F.length(user) - F.length(marks), F.lit(12)), F.lit(24))), F.lit("@"), _hexlike(key, "domain", F.lower(F.substring_index(v, "@", -1)), F.lit(8)), F.lit(".invalid"))
    aws = F.concat(F.lit("AKIA"), F.upper(_hexlike(key, "awskey", v, F.lit(16))))
    hexkey = _hexlike(key, "hexkey", F.lower(v), F.lit(40))
    octets = F.transform(F.split(v, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("long"))
    ip = lambda o: once(
        feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536), key, F.lit("ipv4")),
        lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["left"] / 256), s["left"] % 256, F.floor(s["right"] / 256), s["right"] % 256)]),
    )
    bare, slash = F.translate(v, "/.-", ""), v.contains("/")
    form = lambda order: F.when(slash, F.lit(order.replace(".", "/"))).otherwise(F.lit(order))
    in_range = lambda d: d.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date"))
    dated = lambda day, form: F.when(in_range(day), F.struct(day.alias("day"), form.alias("form")))
    readings = F.when(v.rlike(full["isodate"]), dated(F.try_to_date(bare, "yyyyMMdd"), F.lit("yyyy-MM-dd"))).otherwise(
        F.coalesce(dated(F.try_to_date(bare, "ddMMyyyy"), form("dd.MM.yyyy")), F.when(slash, dated(F.try_to_date(bare, "MMddyyyy"), form("MM.dd.yyyy"))))
    )
    date = once(readings, lambda x: F.when(x.isNull(), keep).otherwise(put("date", _permute_date(x, key))))
    ssn_ok = ~digits.rlike("^(?:000|666|9)") & ~F.substr(digits, F.lit(4), F.lit(2)).eqNullSafe("00") & ~F.substr(digits, F.lit(6), F.lit(4)).eqNullSafe("0000")
    country = F.when(v.startswith("+"), F.regexp_extract(v, r"^\+([0-9]{1,3})(?=[ .(-])", 1)).otherwise(F.lit(""))
    phone = reshape(v, F.concat(country, permute_digits(F.substr(digits, F.length(country) + 1, n), key, F.concat(F.lit("phone"), country))))
    body = permute_digits(F.substr(digits, F.lit(2), n - 2), key, F.concat(F.lit("card"), F.substr(digits, F.lit(1), F.lit(1))))
    card_head = once(F.concat(F.substr(digits, F.lit(1), F.lit(1)), body), lambda h: F.concat(h, check_digit(h)))
    luhn = check_digit(F.substr(digits, F.lit(1), n - 1)) == F.substr(digits, n, F.lit(1))
    return (
        F.when(v.rlike(full["email"]), put("email", mail))
        .when(v.rlike(full["awskey"]), put("awskey", aws))
        .when(v.rlike(full["hexkey"]), put("hexkey", F.when(v.rlike("[A-F]") & ~v.rlike("[a-f]"), F.upper(hexkey)).otherwise(hexkey)))
        .when(v.rlike(full["ipv4"]), once(octets, lambda o: F.when(F.array_max(o) <= 255, put("ipv4", ip(o))).otherwise(keep)))
        .when(v.rlike(f"{full['isodate']}|{full['dmydate']}"), date)
        .when(v.rlike(full["ssn"]), F.when(ssn_ok, put("ssn", reshape(v, _permute_ssn(digits, key)))).otherwise(keep))
        .when(v.rlike(full["phone"]), put("phone", phone))
        .when(v.rlike(full["card"]) & luhn, put("card", reshape(v, card_head)))
        .otherwise(keep)
    )


def pseudonymize(text: Column, key: str) -> tuple[Column, Callable[[Column], Column]]:
    """The pieces of a text, and how to join them: an array of structs (before, kind, value), null for a null text."""
    opened = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), _opened)
    made = F.transform(opened, lambda x: F.struct(x["head"].alias("head"), x["inner"].alias("inner"), x["tail"].alias("tail"), _pseudonym(x["inner"], key).alias("m")))
    matches = F.concat(F.transform(made, lambda x: _replacement(x, key)), F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("value"))))
    parts = F.zip_with(F.split(text, ANY, -1), matches, lambda before, m: F.struct(before.alias("before"), m["kind"].alias("kind"), m["value"].alias("value")))
    return F.when(maybe(text), parts), lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["before"], x["value"])), "")


def _replaced(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, str, Column]:
    made, join = pseudonymize(F.col(text), key)
    parts = fresh_name(docs, "parts")
    return docs.withColumn(parts, made), parts, F.when(F.col(parts).isNull(), F.col(text)).otherwise(join(F.col(parts)))


def pseudonymize_column(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs with the column ``text`` rewritten; all other columns and their order stay. Row by row, without a shuffle."""
    out, parts, new = _replaced(docs, text, key)
    return out.select(*[new.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, rewritten text, number of values replaced, and their kinds (distinct, sorted, comma-joined)."""
    out, parts, new = _replaced(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", key)
    kinds = F.filter(F.transform(F.coalesce(F.col(parts), F.array().cast("array<struct<before:string,kind:string,value:string>>")), lambda x: x["kind"]), lambda k: k.isNotNull())
    return out.select(F.col("id").alias(id_col), new.alias("text"), F.size(kinds).cast("long").alias("n_values"), F.array_join(F.sort_array(F.array_distinct(kinds)), ",").alias("kinds"))
