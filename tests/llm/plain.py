"""Plain versions of the operators, in whole-table Python loops, for small fixtures."""

import re

SPACES = "[^\x20\x09-\x0D]+"
ALNUM = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, size):
    words = re.findall(SPACES, lowered(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def jaccard_components(rows, size, share):
    """rows: (id, text), ids distinct. id -> (set size, least id reached)."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    head = {i: i for i in sets}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                head[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def contamination(docs, items, window=10):
    """id -> (words, hit words, item ids)."""
    known = {}
    for item, text in items:
        words = re.findall(ALNUM, lowered(text))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            known.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    out = {}
    for i, text in docs:
        words, hit, found = re.findall(ALNUM, lowered(text)), set(), set()
        for size in {len(w) for w in known}:
            for k in range(len(words) - size + 1):
                if (items_here := known.get(tuple(words[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= items_here
        out[i] = (len(words), len(hit), sorted(found))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal_data(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def secrets(text):
    text, out = text or "", []
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def quality(text):
    """words, word characters, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    words = re.findall(SPACES, text)
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {p + n for own in places.values() if len(own) > 1 for p in own for n in range(8)}
    lines = [x for x in text.split("\n") if re.search(SPACES, x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
