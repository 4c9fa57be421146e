"""Personal data replaced by plain Python, one value at a time: what the column expressions are tested against."""

import datetime
import hashlib
import re

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Candidates of a kind, each tried at every place in turn.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"{OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-])",
    "phone": r"(?:(?:\+?1[ .-]?)?\([2-9]\d\d\)[ .-]?[2-9]\d\d[ .-]?\d{4}(?!\w)|\+1[ .-]?[2-9]\d\d[ .-]?[2-9]\d\d[ .-]?\d{4}(?!\w)|(?:1[ .-])?[2-9]\d\d[ .-][2-9]\d\d[ .-]\d{4}(?![\w-]))",
    "abroad": r"\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)",
    "card": r"\d(?:[ -]?\d){12,18}(?![\w-])",
}
#: Characters that may not stand before a match.
BEFORE = {"email": r"[A-Za-z0-9._%+-]", "iban": r"[A-Za-z0-9]", "ip": r"[\w.]", "ssn": r"[\w-]", "date": r"[\w/.-]", "phone": r"[\w+]", "abroad": r"[\w+]", "card": r"[\w.+-]"}


def find(text, at):
    """(kind, end) of the match that starts here, or None."""
    for kind, pattern in KINDS.items():
        before = text[at - 1 : at]
        if before and re.fullmatch(BEFORE[kind], before, re.A):
            continue
        m = re.compile(pattern, re.A).match(text, at)
        if not m:
            continue
        end = m.end()
        if kind == "email":
            while not re.search(r"@.*\.[A-Za-z]{2,24}$", text[at:end]) and "@" in text[at : end - 2]:
                end -= 1
            if not re.search(r"@[A-Za-z0-9-].*\.[A-Za-z]{2,24}$", text[at:end]):
                continue
        if kind == "ssn" and (m[0][:3] in ("000", "666") or m[0][0] == "9" or m[0][4:6] == "00" or m[0][7:] == "0000"):
            continue
        if kind == "phone" and before and before in ".-" and "(" not in m[0] and m[0][0] != "+":
            continue
        return kind, end
    return None


def prf(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(x, y, p, q, key):
    for i in range(8):
        x, y, p, q = y, (x + prf(key, i, p, q, y) % p) % p, q, p
    return x, y


def permute(d, key):
    if not d:
        return d
    half, rest = len(d) // 2, len(d) - len(d) // 2
    x, y = feistel(int(d[:half] or 0), int(d[half:]), 10**half, 10**rest, key)
    return (str(x).zfill(half) if half else "") + str(y).zfill(rest)


def refill(m, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in m)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def day(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def shifted(x, hexed):
    out = []
    for i, c in enumerate(x):
        by = int(hexed[i % 16 * 4 : i % 16 * 4 + 4], 16)
        for low, n in ((97, 26), (65, 26), (48, 10)):
            if low <= ord(c) < low + n:
                c = chr(low + (ord(c) - low + by) % n)
                break
        out.append(c)
    return "".join(out)


def pseudonym(kind, m, key):
    key, d = key + kind, re.sub("[^0-9]", "", m)
    if kind == "email":
        local, domain = m.split("@")
        x, y = local[: len(local) // 2], local[len(local) // 2 :]
        for i in range(8):
            x, y = y, shifted(x, hashlib.sha256("|".join([key, str(i), y]).encode()).hexdigest())
        return f"{x}{y}@{domain}"
    if kind == "iban":
        plain = m.replace(" ", "")
        if mod97(plain[4:] + plain[:4]) != 1:
            return m
        digits = permute(re.sub("[^0-9]", "", plain[4:]), key)
        return refill(m, str(98 - mod97(refill(plain[4:], digits) + plain[:2] + "00")).zfill(2) + digits)
    if kind == "ip":
        o = list(map(int, m.split(".")))
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key)
        return ".".join(str(v) for h in (x, y) for v in divmod(h, 256))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        x, y = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key)
        a, g = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{y + 1:04d}"
    if kind == "date":
        sign = re.search(r"[-/.]", m)[0]
        p = m.split(sign)
        first, second = (day(*p), None) if sign == "-" else (day(p[2], p[1], p[0]), day(p[2], p[0], p[1]))
        value, n = first or second, None
        if value:
            n = (value - datetime.date(1800, 1, 1)).days
        if n is None or not 0 <= n < 146_097:
            return m
        x, y = feistel(n // 773, n % 773, 189, 773, key)
        new = datetime.date(1800, 1, 1) + datetime.timedelta(days=x * 773 + y)
        parts = [f"{new.year}", f"{new.month:02d}", f"{new.day:02d}"]
        return sign.join(parts if sign == "-" else [parts[2], parts[1], parts[0]] if first else [parts[1], parts[2], parts[0]])
    if kind == "phone":
        x, y = feistel((int(d[-10:-7]) - 200) * 800 + int(d[-7:-4]) - 200, int(d[-4:]), 640_000, 10_000, key)
        return refill(m, d[:-10] + str(x // 800 + 200) + str(x % 800 + 200) + f"{y:04d}")
    if kind == "abroad":
        return refill(m, d[:2] + permute(d[2:], key)) if 8 <= len(d) <= 15 else m
    if not luhn(d):
        return m
    body = d[0] + permute(d[1:-1], key)
    return refill(m, body + next(str(c) for c in range(10) if luhn(body + str(c))))


def pseudonymise(text, key):
    """(new text, how many values changed)"""
    out, at, changed = [], 0, 0
    while at < len(text):
        if found := find(text, at):
            kind, end = found
            new = pseudonym(kind, text[at:end], key)
            changed += new != text[at:end]
            out.append(new)
            at = end
        else:
            out.append(text[at])
            at += 1
    return "".join(out), changed
