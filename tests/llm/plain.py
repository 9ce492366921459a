"""The same results by the plainest way, one item after another: what operators are held against."""

import re

import numpy as np
from strandspark.llm import secrets, toxicity
from strandspark.llm.common import hashed

MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def toxicity_score(model, text):
    """The highest mean over the windows of a text of its words' means of n-gram weights."""
    words = re.findall(rb"[0-9A-Za-z'\x80-\xff]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words]
    value, last, scores = {}, {}, []
    for k, w in enumerate(words):
        if w not in value:
            own = [256, *w, 257]
            buckets = [int(hashed(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])]
            for n in toxicity.LENGTHS:
                for a in range(len(own) - n + 1):
                    rolled = 0
                    for c in own[a : a + n]:
                        rolled = (rolled * 1000003 + c + 1) & MASK
                    buckets.append(mix((rolled + n) & MASK))
            value[w] = float(np.mean([model.weights[b % toxicity.BUCKETS] for b in buckets]))
        scores.append(value[w] if w not in last or k - last[w] >= toxicity.WINDOW else 0.0)
        last[w] = k
    half = toxicity.WINDOW // 2
    starts = range(0, max(1, len(scores) - half), half) if scores else []
    logit = max((sum(scores[a : a + toxicity.WINDOW]) / toxicity.WINDOW for a in starts), default=0.0) + model.bias
    return 1 / (1 + np.exp(-logit))


def rule_spans(text):
    """(start, kind, end) of what the rules find, in characters."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def network_score(net, raw, start, end):
    """The network on one piece of a text's bytes, place by place."""
    codes = []
    for k in range(start - secrets.BEFORE, start):
        codes.append(code(raw[k]) if k >= 0 else 0)
    for k in range(start, start + secrets.INSIDE):
        codes.append(97 + (code(raw[k]) if k < end else 0))
    for k in range(end, end + secrets.AFTER):
        codes.append(194 + (code(raw[k]) if k < len(raw) else 0))
    letters, kernel, bias, out = net.parameters
    hidden = [np.maximum(letters[codes[k : k + net.WIDTH]].T.reshape(-1) @ kernel + bias, 0) for k in range(len(codes) - net.WIDTH + 1)]
    logit = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0), [1]]) @ out
    return 1 / (1 + np.exp(-(net.slope * logit + net.shift)))


def code(byte):
    return byte - 31 if 32 <= byte < 127 else 96


def model_spans(net, text):
    """(start, end) of what the network adds, in characters: every run, its parts, in overlapping pieces, one by one."""
    raw, out = text.encode(), []
    rules = [(len(text[:a].encode()), len(text[:b].encode())) for a, _, b in rule_spans(text)]
    for m in re.finditer(rb"[A-Za-z0-9+/_.=-]{12,}", raw):
        runs = [m.span(), *((m.start() + p.start(), m.start() + p.end()) for p in re.finditer(rb"[A-Za-z0-9+]{12,}", m[0]))]
        best = 0.0
        for a, b in runs:
            for k in range(a, max(a + 1, b - secrets.INSIDE + secrets.INSIDE // 2), secrets.INSIDE // 2):
                first = min(k, max(a, b - secrets.INSIDE))
                best = max(best, network_score(net, raw, first, min(first + secrets.INSIDE, b)))
        if best >= net.threshold and not any(a < m.end() and m.start() < b for a, b in rules):
            out.append((len(raw[: m.start()].decode()), len(raw[: m.end()].decode())))
    return out


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def least_edits(item, text):
    """The fewest words to insert, delete or replace that make ``item`` a part of ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, a in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + np.array([a != b for b in text], np.int64)) if text else np.zeros(0, np.int64)
        row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
    return int(row.min())


def leaks(item, text):
    p, t = words(item), words(text)
    return bool(p) and least_edits(p, t) <= (len(p) // 5 if len(p) >= 5 else 0)
