"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

from rankloom.llm import quality, secrets

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- benchmark decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(text, items):
    """n_words, n_hit, n_items, digest and verdict for one text against (item_id, text) pairs."""
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        theirs = words(passage)
        n = min(13, len(theirs))
        windows = {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i:i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(own)


# ---------------------------------------------------------------- secrets


def spans(text):
    """(start, rank, stop, kind) of all rules, matched first and dropped after."""
    out = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+", "jwt": r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)"}.get(rule.kind, rule.pattern)
        least = {"access": 20, "hex": 24}.get(rule.kind, rule.least)
        for m in re.finditer(pattern, text or ""):
            if len(m[rule.group]) >= least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def redacted(text, mask="[SECRET]"):
    out, at = "", 0
    for start, _, stop, _ in spans(text):
        if start >= at:
            out += text[at:start] + mask
        at = max(at, stop)
    return out + text[at:]


# ---------------------------------------------------------------- fingerprints


def fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(own[i:i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def first_of_groups(rows):
    """Places of the (doc_id, text) rows that stay: those whose id is the smallest of what their row is linked to, once for each id and fingerprint."""
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(prints):
        for j, y in enumerate(prints[:i]):
            if (x ^ y).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    best = {}
    for i, (d, t) in enumerate(rows):
        if d is not None and d == least[root(i)]:
            key = d, prints[i]
            if key not in best or (t or "", i) < (rows[best[key]][1] or "", best[key]):
                best[key] = i
    return {*best.values(), *(i for i, (d, _) in enumerate(rows) if d is None)}


# ---------------------------------------------------------------- the language model


def _grams(text, order):
    own = [0] * (order - 1) + [ord(c) + 1 for c in text]
    return [tuple(own[i:i + order]) for i in range(len(text))]


class Model:
    """Interpolated modified Kneser-Ney over tuples of symbols."""

    def __init__(self, texts, order):
        counts = {order: Counter(g for t in texts for g in _grams(t, order))}
        for n in range(order - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        self.order, self.p, self.bow = order, {}, {}
        for n in range(1, order + 1):
            of = Counter(counts[n].values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5
            d = {i: min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.05), i - 0.05) if of[i] else i * 0.5 for i in (1, 2, 3)}
            whole, taken = Counter(), defaultdict(float)
            for g, c in counts[n].items():
                whole[g[:-1]] += c
                taken[g[:-1]] += d[min(c, 3)]
            for context, total in whole.items():
                self.bow[n, context] = taken[context] / total
            for g, c in counts[n].items():
                self.p[g] = (c - d[min(c, 3)]) / whole[g[:-1]] + self.bow[n, g[:-1]] * (self.p[g[1:]] if n > 1 else 1 / quality.SYMBOLS)

    def prob(self, g):
        if not g:
            return 1 / quality.SYMBOLS
        return self.p[g] if g in self.p else self.bow.get((len(g), g[:-1]), 1.0) * self.prob(g[1:])

    def nll(self, text):
        return -sum(math.log(self.prob(g)) for g in _grams(text, self.order))


def held_out(doc_id):
    return int(hashlib.md5(str(doc_id).encode()).hexdigest()[:8], 16) % quality.HELD_OUT == 0


def judged(docs, labels, order=quality.ORDER):
    """Of (doc_id, lang, text), with labels (doc_id, quality, toxic): characters, perplexity, smoothed perplexity, threshold, held-out documents."""
    good = {d for d, *_ in labels if max(q for x, q, _ in labels if x == d) == 1 and max(t for x, _, t in labels if x == d) == 0}
    trusted = [(d, lang or "", t or "") for d, lang, t in docs if d in good]
    train = [(lang, t) for d, lang, t in trusted if not held_out(d)]
    models = {lang: Model([t for x, t in train if x == lang], order) for lang in {x for x, t in train if t}}
    models["*"] = Model([t for _, t in train], order)
    surprise = lambda lang, t: models.get(lang, models["*"]).nll(t)
    held = [(lang, len(t), surprise(lang, t)) for d, lang, t in trusted if held_out(d) and t]
    mean = {x: sum(n for lang, _, n in held if lang == x) / sum(c for lang, c, _ in held if lang == x) for x in {h[0] for h in held}}
    over = defaultdict(list)
    for lang, c, n in held:
        bin_ = math.ceil(((n + quality.PRIOR * mean[lang]) / (c + quality.PRIOR) - mean[lang]) * quality.BIN)
        over[lang].append(bin_)
        over["*"].append(bin_)
    above = {x: sorted(v)[math.ceil(quality.QUANTILE * len(v)) - 1] / quality.BIN for x, v in over.items()}
    limits = {x: (m, m + (len(over[x]) * above[x] + quality.BACK_OFF * above["*"]) / (len(over[x]) + quality.BACK_OFF) + quality.SLACK, len(over[x])) for x, m in mean.items()}
    whole = sum(n for *_, n in held) / sum(c for _, c, _ in held)
    out = []
    for d, lang, t in docs:
        m, most, behind = limits.get(lang or "", (whole, whole + above["*"] + quality.SLACK, 0))
        nll, n = surprise(lang or "", t or ""), len(t or "")
        out.append((n, math.exp(nll / n if n else m), math.exp((nll + quality.PRIOR * m) / (n + quality.PRIOR)), math.exp(most), behind))
    return out


def kept(docs, labels, order=quality.ORDER):
    return [smoothed <= most for _, _, smoothed, most, _ in judged(docs, labels, order)]
