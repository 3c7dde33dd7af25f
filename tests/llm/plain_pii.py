"""The pseudonyms of personal data in plain Python: same patterns and key, everything else written anew."""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import regex

from tidemark.llm import pii

ORDER = ["email", "secret", "date", "ip", "ssn", "card", "phone"]


def sha(*parts):
    return hashlib.sha512("".join(map(str, parts)).encode()).hexdigest()


def shift(half, by, hexadecimal):
    out = ""
    for i, c in enumerate(half):
        step = int(by[2 * (i % 64) : 2 * (i % 64) + 2], 16)
        if hexadecimal:
            out += "0123456789abcdef"[(int(c, 16) + step) % 16]
        elif "0" <= c <= "9":
            out += chr(48 + (ord(c) - 48 + step) % 10)
        elif "a" <= c <= "z":
            out += chr(97 + (ord(c) - 97 + step) % 26)
        else:
            out += c
    return out


def chars(value, key, hexadecimal=False):
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for r in range(1, 9):
        a, b = b, shift(a, sha(key, "|", r, "|", b), hexadecimal)
    return a + b


def pair(x, y, nx, ny, key):
    for r in range(1, 9):
        if r % 2:
            x = (x + int(sha(key, "|x|", r, "|", y)[:12], 16)) % nx
        else:
            y = (y + int(sha(key, "|y|", r, "|", x)[:12], 16)) % ny
    return x, y


def fill(shape, new, digits_only=True):
    it = iter(new)
    return "".join((lambda n: n.upper() if "A" <= c <= "Z" else n)(next(it)) if c.isascii() and (c.isdigit() or not digits_only and c.isupper()) else c for c in shape)


def check_digit(body):
    return -sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, body[::-1]))) % 10


def rest97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(m, key):
    flat = m.replace(" ", "")
    if rest97(flat[4:] + flat[:4]) != 1:
        return None
    new = chars(flat[4:].lower(), key).upper()
    return fill(m, flat[:2] + f"{98 - rest97(new + flat[:2] + '00'):02d}" + new, digits_only=False)


def date(m, key):
    x = re.split("[-./]", m)
    first_is_year = len(x[0]) == 4
    american = not first_is_year and int(x[1]) > 12
    y, mo, d = (x if first_is_year else (x[2], x[0], x[1]) if american else (x[2], x[1], x[0]))
    try:
        n = (dt.date(int(y), int(mo), int(d)) - dt.date(1900, 1, 1)).days
    except ValueError:
        return None
    while True:
        a, b = pair(n // 4297, n % 4297, 17, 4297, key)
        n = a * 4297 + b
        new = dt.date(1900, 1, 1) + dt.timedelta(n)
        if (new.day > 12) == (int(d) > 12):
            break
    order = [new.year, new.month, new.day] if first_is_year else [new.month, new.day, new.year] if american else [new.day, new.month, new.year]
    seps = re.findall("[-./]", m)
    return "".join(str(v).zfill(len(old) if len(old) > 1 else 1) + s for v, old, s in zip(order, x, [*seps, ""], strict=True))


def phone(m, key):
    d = re.sub("[^0-9]", "", m)
    code = 0 if m[0] != "+" else 1 if m[1:].isdigit() else len(re.match(r"\+([0-9]+)", m)[1])
    own = min(10, len(d) - code)
    return fill(m, d[: len(d) - own] + chars(d[-own:], key))


def email(m, key):
    local, domain = m.split("@")
    return "".join(n.upper() if "A" <= c <= "Z" else n for c, n in zip(local + "@", chars(local.lower() + "@", key), strict=True)) + domain


def secret(m, key):
    new = chars(m.lower(), key, True)
    if re.search("[A-F]", m):
        return "".join(c.upper() if "A" <= old <= "F" else c for old, c in zip(m, new, strict=True)) if re.search("[a-f]", m) else new.upper()
    return new


def ip(m, key):
    a, b, c, d = map(int, m.split("."))
    x, y = pair(a * 256 + b, c * 256 + d, 65536, 65536, key)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def ssn(m, key):
    areas = [i for i in range(1, 900) if i != 666]
    x, y = pair(areas.index(int(m[:3])) * 99 + int(m[4:6]) - 1, int(m[7:]) - 1, 898 * 99, 9999, key)
    return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def card(m, key):
    d = re.sub("[^0-9]", "", m)
    if check_digit(d[:-1]) != int(d[-1]):
        return None
    new = chars(d[:-1], key)
    return fill(m, new + str(check_digit(new)))


ONE = {"email": email, "secret": secret, "date": date, "ip": ip, "ssn": ssn, "card": card, "phone": phone}
ANY = regex.compile("|".join(f"(?:{pii.PATTERNS[k]})" for k in ORDER))
IBAN = regex.compile(pii.PATTERNS["iban"])


def others(text, key, kinds):
    def new(found):
        m = found[0]
        for kind in ORDER:
            fits = "@" in m if kind == "email" else regex.fullmatch(pii.PATTERNS[kind], m)
            if fits and (out := ONE[kind](m, f"{key}|{kind}")) is not None:
                kinds.append(kind)
                return out
        return m

    return ANY.sub(new, text)


def rewritten(text, key=pii.KEY):
    """The text with its values replaced, and their kinds."""
    if text is None:
        return None, []
    kinds: list[str] = []
    out, open_text, at = "", "", 0
    for found in IBAN.finditer(text):
        open_text += text[at : found.start()]
        at = found.end()
        new = iban(found[0], f"{key}|iban")
        if new is None:
            open_text += found[0]
        else:
            out += others(open_text, key, kinds) + new
            kinds.append("iban")
            open_text = ""
    return out + others(open_text + text[at:], key, kinds), kinds
