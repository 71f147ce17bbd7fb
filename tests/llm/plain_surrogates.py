"""The surrogates of a few kinds in plain Python, text by text, to hold the operator against."""

from __future__ import annotations

import hashlib

import regex

from chomeflow.llm import pii_surrogates as P


def kind_of(mention: str) -> str:
    return next(k for k, pattern in P.KINDS.items() if k == "name" or regex.fullmatch(pattern, mention))


def _title(mention: str) -> str:
    titles = sorted(P.FEMALE_TITLES + P.MALE_TITLES + P.OTHER_TITLES, key=len, reverse=True)
    word = next(t for t in titles if mention.startswith((t + " ", t + ". ")))
    return mention[: mention.index(" ", len(word)) + 1]


def value_of(kind: str, mention: str) -> str:
    digits = "".join(c for c in mention if c in "0123456789")
    if kind == "email":
        return mention.lower()
    if kind == "ipv4":
        return mention
    if kind in ("card", "ssn"):
        return digits
    if kind == "phone":
        if mention.startswith("+"):
            bare = digits[1:] if digits[0] in "17" else digits[2:] if digits[:2] in P.CALLING_2 else digits[3:]
        else:
            bare = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        return (bare[1:] if bare[0] == "0" else bare) if len(bare) > 6 else digits
    raise NotImplementedError(kind)


def _script(c: str) -> str:
    return "cyrillic" if any("\u0400" <= x <= "\u04ff" for x in c) else "latin"


def _halves(mention: str) -> tuple[str, str]:
    """Given names and surname."""
    words = mention[len(_title(mention)) :].split(" ")
    small = [i for i, w in enumerate(words) if w in P.PARTICLES]
    n = small[0] if small else 2 if len(words) == 4 and not words[2].endswith(".") else len(words) - 1
    return " ".join(words[:n]), " ".join(words[n:])


def _tokens(phrase: str) -> list[tuple[str, bool]]:
    """Tokens, and whether each is replaced."""
    return [(t, len(t) > 1 and t[0].isalpha() and t not in P.PARTICLES) for t in regex.findall(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+", phrase)]


def _given_entity(mention: str) -> list[tuple[str, str]]:
    given, surname = _halves(mention)
    word = _title(mention).rstrip(". ")
    gender = "f" if word in P.FEMALE_TITLES else "m" if word in P.MALE_TITLES else "n"
    words = [t for t, new in _tokens(given) if new]
    return [("given", f"{gender}|{_script(given)}|{' '.join(words).lower()}|{surname.lower()}")] if words else []


def entities(mention: str) -> list[tuple[str, str]]:
    kind = kind_of(mention)
    if kind != "name":
        return [(kind, value_of(kind, mention))]
    return _given_entity(mention) + [("surname", f"{_script(t)}|{t.lower()}") for t, new in _tokens(_halves(mention)[1]) if new]


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def surrogate(kind: str, value: str, attempt: int, key: str) -> str:
    digest = hashlib.sha512("\x1f".join((key, kind, value, str(attempt))).encode()).digest()
    byte = lambda i: digest[i % 64]
    late = max(0, attempt - P.ROOMY + 1)
    if kind == "email":
        top = value.rindex(".") + 1
        new = "".join(c if i >= top or not c.isascii() or not c.isalnum() else str(byte(i) % 10) if c.isdigit() else chr(97 + byte(i) % 26) for i, c in enumerate(value))
        local, domain = new.split("@")
        return local + "".join(chr(97 + byte(i + 23) % 26) for i in range(1, attempt + 1)) + "@" + domain
    more = "".join(str(byte(i + 23) % 10) for i in range(1, late + 1))
    if kind == "ipv4":
        return ".".join(str(byte(i) % 254 + 1) for i in range(4)) + (":" + more if late else "")
    syllables = lambda script, n, first: "".join(P.SYLLABLES[script][byte(first + i) % 16] for i in range(1, n + 1))
    if kind == "given":
        gender, script, names, surname = value.split("|")
        options, n = P.GIVEN[script, gender], len(names.split(" "))
        return f"{gender}|{script}|" + " ".join(options[byte(i) % len(options)].lower() for i in range(1, n + 1)) + syllables(script, attempt, n) + "|" + surname
    if kind == "surname":
        script = value.split("|")[0]
        return script + "|" + syllables(script, 4 + attempt, 0)
    number = "".join(str(byte(i) % 10) for i in range(len(value))) + more
    if kind == "card" and _luhn(value) == 0:
        number = number[:-1] + str((10 - _luhn(number[:-1] + "0")) % 10)
    return number


def resolved(values: set[tuple[str, str]], key: str) -> dict[tuple[str, str], str]:
    attempts = dict.fromkeys(values, 0)
    while True:
        now = {kv: surrogate(*kv, n, key) for kv, n in attempts.items()}
        holders: dict[tuple[str, str], list[str]] = {}
        for (kind, value), s in now.items():
            holders.setdefault((kind, s), []).append(value)
        fails = [(k, v) for (k, s), vs in holders.items() for v in vs if (k, s) in attempts or v != min(vs)]
        if not fails:
            return now
        for kv in fails:
            attempts[kv] += 1


def _like(mention: str, new: str) -> str:
    return "".join(c.upper() if i < len(mention) and mention[i].isupper() else c for i, c in enumerate(new))


def _shown(mention: str, new: dict[tuple[str, str], str]) -> tuple[str, str]:
    like = lambda t, w: w.upper() if t == t.upper() else w.capitalize()
    given, surname = _halves(mention)
    words = iter([w for e in _given_entity(mention) for w in new[e].split("|")[2].split(" ")])
    given = "".join(like(t, next(words)) if fresh else t for t, fresh in _tokens(given))
    return given, "".join(like(t, new["surname", f"{_script(t)}|{t.lower()}"].split("|")[1]) if fresh else t for t, fresh in _tokens(surname))


def rendered(kind: str, mention: str, value: str, new: str) -> str:
    if kind == "email":
        (a, b), (x, y) = mention.split("@"), new.split("@")
        return _like(a, x) + "@" + _like(b, y)
    if kind == "ipv4":
        return new
    digits = "".join(c for c in mention if c in "0123456789")
    left = iter(digits[: len(digits) - len(value)] + new)
    return "".join(next(left) if c in "0123456789" else c for c in mention) + "".join(left)


def masked(texts: list[str | None], key: str) -> list[tuple[str | None, int]]:
    found = [regex.findall(f"(?:{P.ANY})", t or "") for t in texts]
    new = resolved({e for ms in found for m in ms for e in entities(m)}, key)
    out = []
    for text, ms in zip(texts, found, strict=True):
        if text is None:
            out.append((None, 0))
            continue
        told = []
        for m in ms:
            if kind_of(m) == "name":
                halves, shown = _halves(m), _shown(m, new)
                told.append(("~", halves[1], shown[1]))
                if halves[0]:
                    word = _title(m).rstrip(". ")
                    told.append(("f" if word in P.FEMALE_TITLES else "m" if word in P.MALE_TITLES else "n", " ".join(halves), " ".join(shown)))
        names: dict[str, str] = {}
        for _, name, shown in sorted(told):
            names.setdefault(name, shown)
        alone = "|".join(regex.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))

        def put(found, names: dict[str, str] = names) -> str:
            m = found[0]
            if m in names and not found["entity"]:
                return names[m]
            if kind_of(m) != "name":
                (kind, value), = entities(m)
                return rendered(kind, m, value, new[kind, value])
            title = _title(m)
            if title.rstrip(". ") in P.OTHER_TITLES and m[len(title) :] in names:
                return title + names[m[len(title) :]]
            return title + " ".join(x for x in _shown(m, new) if x)

        out.append((regex.sub(f"(?P<entity>{P.ANY})" + (rf"|(?<!\p{{L}})(?:{alone})(?![\p{{L}}\p{{M}}])" if names else ""), put, text), len(ms)))
    return out
