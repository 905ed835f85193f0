"""Plain forms of the operators, to hold their results against."""

import collections
import hashlib
import re

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(SPACE, text or "")


def quality(text, limits, line_limit):
    text = text or ""
    w = words(text)
    n = len(w)
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, words(line)))
            seen.add(line)

    def covered(k, least_rank):
        where = collections.defaultdict(list)
        for i in range(n - k + 1):
            where[tuple(w[i : i + k])].append(i)
        return {p for at in where.values() if len(at) > 1 for s in at[least_rank:] for p in range(s, s + k)}

    repeats = len(covered(3, 0))
    chars = sum(map(len, w))
    failed = n < 50 or 100 * repeats > 50 * n
    shares = [sum(len(w[p]) for p in covered(k, 1)) / chars for k in limits] if n else [0]
    kept = not failed and dup_chars <= line_limit * chars and all(s <= limit for s, limit in zip(shares, limits.values(), strict=True))
    return n, chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeats, failed, kept


def line_windows(lines, short_texts=False):
    counted = [(i, x) for i, x in enumerate(lines) if words(x)]
    k = min(3, len(counted)) if short_texts else 3
    if not counted:
        return []
    return [(counted[j][0], counted[j + k - 1][0], tuple(x for _, x in counted[j : j + k])) for j in range(len(counted) - k + 1)]


def line_dedup(docs, short_texts=False):
    """[(doc_id, text)] of different ids to {doc_id: (text, n_lines, n_removed)}."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        if text is None:
            out[doc_id] = (None, 0, 0)
            continue
        lines, gone = text.split("\n") if text else [], set()
        for start, stop, key in sorted(line_windows(lines, short_texts)):
            if key in seen:
                gone.update(range(start, stop + 1))
            seen.add(key)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(docs):
    """[(doc_id, text)] of different ids to {doc_id: (n_shingles, component_id, kept)}."""
    sets = {i: shingles(t) for i, t in docs}
    where, parent = collections.defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            where[g].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for o, k in collections.Counter(o for g in s for o in where[g] if o < i).items():
            if 100 * k >= 75 * (len(s) + len(sets[o]) - k):
                a, b = find(i), find(o)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def licenses(text, base, templates, least):
    """(labels, score) by trying every template at every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, score = set(), 0.0
    for template, key, label, share in [*((p, p, x, 1.0) for p, x in base), *((*t, least) for t in templates)]:
        t, k = template.split(), key.split()
        at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        for start in range(-len(t), len(w)):
            here = [0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(t)]
            if all(here[at : at + len(k)]) and sum(here) / len(t) >= share:
                labels.add(label)
                score = max(score, sum(here) / len(t))
    return ",".join(sorted(labels)), score


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def pii_base(text):
    found = []
    for k, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    shown = ",".join(x for _, _, x in sorted(found))
    counts = collections.Counter(k for _, k, _ in found)
    return *(counts[k] for k in range(4)), hashlib.sha256(shown.encode()).hexdigest(), shown


def confident(occurrences, plain, seeds, least, rounds, threshold, formed):
    """{(kind, pattern): confidence} by the scoring rounds over plain dictionaries.

    occurrences: (type, pattern, instance, kinds, failed kinds); plain: {pattern: words in its
    context}; seeds: {(kind, instance)}. An occurrence ends with the kinds whose check it fails.
    """
    places, members = collections.Counter(), collections.defaultdict(set)
    for type_, pattern, instance, kinds, wrong in occurrences:
        places[pattern] += 1
        for k in kinds:
            others = {kind for kind, i in seeds if i == instance}
            members[k, type_, pattern].add((instance, bool(others) and k not in others or k in wrong))
    score = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        out = {}
        for (kind, type_, pattern), found in members.items():
            good = [score[kind, i] for i, _ in found if (kind, i) in score]
            if len(found) < least or len(good) < least:
                continue
            bad = sum(wrong and (kind, i) not in score for i, wrong in found)
            n = len(found) if type_ == formed else len(good) + bad + max(0, plain.get(pattern, 0) - places[pattern])
            if sum(good) / (n + 1) >= threshold:
                out[kind, pattern] = sum(good) / (n + 1)
        score = dict.fromkeys(seeds, 1.0)
        for (kind, _, pattern), found in members.items():
            for i, _ in found:
                if (kind, pattern) in out:
                    score[kind, i] = max(score.get((kind, i), 0), out[kind, pattern])
    return out


def context_words(texts):
    """Counter of ("before", words) and ("around", word, word) over all word places."""
    out = collections.Counter()
    for t in texts:
        w = ["#" if re.search("[0-9@]", x) else x for x in words((t or "").lower())]
        for i in range(1, len(w)):
            if w[i - 1] != "#":
                out["before", w[i - 1] if i < 2 or w[i - 2] == "#" else f"{w[i - 2]} {w[i - 1]}"] += 1
                if i + 1 < len(w):
                    out["around", w[i - 1], w[i + 1]] += 1
    return out


def pairwise_scores(x, good, pairs, seed, penalty, threshold):
    """Bradley-Terry strengths by plain gradient descent on all drawn pairs, as scores."""
    import numpy as np

    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = np.clip((x - x.mean(axis=0)) / scale, -5, 5)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    w, step = np.zeros(x.shape[1]), 4 / np.linalg.eigvalsh(diff.T @ diff / pairs).max()
    for _ in range(20_000):
        slope = penalty * w - diff.T @ (1 / (1 + np.exp(diff @ w))) / pairs
        w = w - step * slope
        if np.abs(slope).max() < 1e-5:
            break
    s = z @ w
    cut = np.quantile(s, (~good).mean(), method="midpoint")
    return 1 / (1 + np.exp(-(2 * (s - cut) / s.std() + np.log(threshold / (1 - threshold)))))


def all_pairs_scores(x, good, bad, penalty, threshold):
    """Bradley-Terry strengths by Newton's method on every pair of a good row and a bad one, as scores; row i stands for good[i] + bad[i] rows."""
    import numpy as np

    rows = np.repeat(x, good + bad, axis=0)
    scale = np.where(rows.std(axis=0) > 1e-9, rows.std(axis=0), 1.0)
    z = np.clip((x - rows.mean(axis=0)) / scale, -5, 5)
    pairs = [(i, j) for i in np.flatnonzero(good) for j in np.flatnonzero(bad)]
    diff = np.array([z[i] - z[j] for i, j in pairs])
    share = np.array([good[i] * bad[j] for i, j in pairs]) / (good.sum() * bad.sum())
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(diff @ w))
        w = w - np.linalg.solve((diff.T * (share * p * (1 - p))) @ diff + penalty * np.eye(len(w)), penalty * w - diff.T @ (share * p))
    s = np.repeat(z @ w, good + bad)
    cut = np.quantile(s, bad.sum() / len(s), method="midpoint")
    return 1 / (1 + np.exp(-(2 * (z @ w - cut) / s.std() + np.log(threshold / (1 - threshold)))))
