"""Plain-Python versions of the operators' contracts, for tests."""

import datetime
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    words = WORD.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def components(docs, width, percent):
    """doc_id -> smallest id that can be reached; ``docs`` is a list of (doc_id, text)."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            common = len(x & y)
            if common and 100 * common >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root}


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def quality_rules(text):
    """The rule values of the quality operator, and whether the base rules fail."""
    n, chars, symbols, dup, repeat = quality_counts(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    share = lambda a, b: a / b if b else 0.0
    values = {
        "symbol_share": share(symbols, chars), "dup_line_share": share(dup, len(lines)),
        "upper_share": share(len(re.findall("[A-Z]", text or "")), chars), "mean_word_chars": share(chars, n),
    }
    return values, n < 10 or 100 * repeat > 20 * n


def tail(n, k, p):
    """P(X <= k) for a binomial variable."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def upper_bound(n, k, level):
    """The exact upper bound of a share of which k of n were seen: where P(X <= k) falls to the level."""
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(n, k, mid) > level else (low, mid)
    return high


def quality_cutoffs(docs, labels, grids, risk):
    """stratum -> rule -> (cutoff or None, good documents, those above); docs: (doc_id, text, stratum); labels: doc_id -> quality."""
    rated = [(s, *quality_rules(t), labels.get(i)) for i, t, s in docs]
    strata = {s for s, *_ in rated}
    level = risk.delta / (len(grids) * (len(strata) + 1))

    def choose(own, rule, grid):
        good, bad = ([v[rule] for v, _, q in own if q == want] for want in (1, 0))
        some, best = False, (0.0, None, None)
        for c in grid:
            k, hit = sum(v > c for v in good), sum(v > c for v in bad)
            if not good or k > len(good) * risk.alpha or tail(len(good), k, risk.alpha) > level:
                break
            gain = hit / max(len(bad), 1) - risk.cost * k / len(good)
            some, best = True, max(best, (gain, c, k), key=lambda x: x[0])
        return some, best[1], len(good), best[2]

    out = {}
    for s in strata:
        for rule, grid in grids.items():
            own = [(v, f, q) for t, v, f, q in rated if not f]
            mine = choose([(v, f, q) for t, v, f, q in rated if not f and t == s], rule, grid)
            out.setdefault(s, {})[rule] = (mine if mine[0] else choose(own, rule, grid))[1:]
    return out, level


def quality_kept(docs, labels, grids, risk):
    """Verdicts for docs, a list of (doc_id, text, stratum)."""
    cut, _ = quality_cutoffs(docs, labels, grids, risk)
    out = []
    for _, t, s in docs:
        values, failed = quality_rules(t)
        out.append(not failed and not any(c is not None and values[r] > c for r, (c, _, _) in cut[s].items()))
    return out


def _feistel(left, right, a, b, key, tweak):
    def keyed(i, x):
        return int(hashlib.sha256("\x1f".join([key, tweak, str(i), str(x), key]).encode()).hexdigest()[:15], 16)

    for i in range(10):
        if i % 2 == 0:
            left = (left + keyed(i, right) % a) % a
        else:
            right = (right + keyed(i, left) % b) % b
    return left, right


def _digits(d, key, tweak):
    if len(d) < 2:
        return d
    u = len(d) // 2
    left, right = _feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), key, f"{tweak}:{len(d)}")
    return f"{left:0{u}d}{right:0{len(d) - u}d}"


def _check_digit(d):
    return str(-sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(d))) % 10)


def _hexlike(key, kind, value, n):
    return "".join(hashlib.sha256(f"{key}\x1f{k}\x1f{value}".encode()).hexdigest() for k in (kind, kind + "2"))[:n]


def _day(text, form):
    try:
        day = datetime.datetime.strptime(text, form).date()
    except ValueError:
        return None
    return day if 1900 <= day.year <= 2099 else None


def _moved_day(day, key):
    n = (day - datetime.date(1900, 1, 1)).days
    left, right = _feistel(n // 4297, n % 4297, 17, 4297, key, "date")
    return datetime.date(1900, 1, 1) + datetime.timedelta(left * 4297 + right)


def _reshape(value, digits):
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in value)


def pseudonym(v, key, patterns):
    """(kind, pseudonym) of a value, or None."""
    kind = next((k for k, p in patterns.items() if re.fullmatch(p, v) and k != "password"), None)
    d = re.sub("[^0-9]", "", v)
    if kind == "email":
        marks = re.match("[._%+-]*", v)[0]
        user, _, host = v[len(marks) :].rpartition("@")
        user = marks + "u" + _hexlike(key, "email", v[len(marks) :].lower(), min(max(len(user), 12), 24))
        return kind, f"{user}@{_hexlike(key, 'domain', host.lower(), 8)}.invalid"
    if kind == "awskey":
        return kind, "AKIA" + _hexlike(key, "awskey", v, 16).upper()
    if kind == "hexkey":
        new = _hexlike(key, "hexkey", v.lower(), 40)
        return kind, new.upper() if re.search("[A-F]", v) and not re.search("[a-f]", v) else new
    if kind == "ipv4":
        o = [int(x) for x in v.split(".")]
        left, right = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4")
        return (kind, ".".join(map(str, (left // 256, left % 256, right // 256, right % 256)))) if max(o) <= 255 else None
    if kind in ("isodate", "dmydate"):
        forms = ["%Y-%m-%d"] if kind == "isodate" else ["%d/%m/%Y", "%m/%d/%Y"] if "/" in v else ["%d.%m.%Y"]
        for form in forms:
            if day := _day(v, form):
                return "date", _moved_day(day, key).strftime(form)
        return None
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        areas = [a for a in range(1, 900) if a != 666]
        left, right = _feistel(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return kind, _reshape(v, f"{areas[left]:03d}{right // 9999 + 1:02d}{right % 9999 + 1:04d}")
    if kind == "phone":
        country = m[1] if (m := re.match(r"\+([0-9]{1,3})(?=[ .(-])", v)) else ""
        return kind, _reshape(v, country + _digits(d[len(country) :], key, f"phone{country}"))
    if kind == "card" and _check_digit(d[:-1]) == d[-1]:
        head = d[0] + _digits(d[1:-1], key, f"card{d[0]}")
        return kind, _reshape(v, head + _check_digit(head))
    return None


def pseudonymized(text, key, patterns, named):
    """(new text, kinds of the values replaced)."""
    kinds = []

    def put(m):
        v = m[0]
        if not re.fullmatch(patterns["password"], v):
            got = pseudonym(v, key, patterns)
        else:
            head = re.match(f"{named}[\"']*", v)[0]
            tail = re.search("[\"']*$", v[len(head) :])[0] if re.search("[\"']((?i:bearer|basic|token)[ \t]+)?$", head) else ""
            inner = v[len(head) : len(v) - len(tail)]
            got = pseudonym(inner, key, patterns)
            if got is None and inner:
                first = _hexlike(key, "password", f"{re.match('[A-Za-z_]+', head)[0].lower()}={inner}", 64)
                more = [hashlib.sha256(f"{key}\x1f{i}\x1f{first}".encode()).hexdigest() for i in range(1, (len(inner) - 1) // 64 + 1)]
                got = "password", "".join([first, *more])[: len(inner)]
            if got:
                got = got[0], head + got[1] + tail
        if got is None:
            return v
        kinds.append(got[0])
        return got[1]

    every = "|".join(f"(?:{p})" for p in patterns.values())
    return re.sub(every, put, text) if text else text, kinds
