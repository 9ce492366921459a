"""Secret scans: fixed rules, and a character convolutional network over every other candidate and its context.

A candidate is a run of token characters that is long enough. The network sees the characters before, in and after it; a
longer run is seen in overlapping pieces, its parts between separators by themselves too, and the highest score counts. It
is trained in numpy on labelled findings: pieces that a rule finds are labelled 1, all others 0,
and the context of half of the former is blanked, so that a secret without a telling keyword is learned too; each is learned
a second time with letters drawn anew, so that a secret that no rule describes is. Addresses, dates, numbers, identifiers
and names of files, made of the corpus's words, are labelled 0 too. Its scores are calibrated on held-out findings, and of the
thresholds at which enough of the held-out secrets are found and few of the harmless texts pass, that with the fewest errors
counts.
What rules find always stays.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, slices, spans, table, utf8, written

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX, _TOKEN = np.zeros(256, bool), np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b"/_.=-"]] = True
LEAST = 12
BEFORE, INSIDE, AFTER = 20, 44, 8
_LETTERS = 97


def _rows_with(low: bytes, word: bytes, offsets: np.ndarray) -> set[int]:
    out, at = set(), low.find(word)
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        out.add(row)
        at = low.find(word, int(offsets[row + 1]) if row + 1 < len(offsets) else len(low))
    return out


def found(data: np.ndarray, offsets: np.ndarray):
    """For ranges of rows: (bytes, offsets, rule spans by row, candidates as (row, start, end)); all in bytes of the range."""
    for row, end in slices(offsets):
        part, own = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        raw = part.tobytes()
        low = raw.lower()
        rules: dict[int, list[tuple[int, int, int]]] = {}
        assigned = set().union(*(_rows_with(low, w, own) for w in _WORDS))
        for k in assigned:
            text = raw[own[k] : own[k + 1]].decode("latin-1")
            rules.setdefault(k, []).extend((0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12)
        for k in _rows_with(raw, b"AKIA", own):
            text = raw[own[k] : own[k + 1]].decode("latin-1")
            rules.setdefault(k, []).extend((1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18)
        starts, ends, _ = spans(~_HEX[part], own)
        for s, e in zip(starts[ends - starts >= 16].tolist(), ends[ends - starts >= 16].tolist(), strict=True):
            k = int(np.searchsorted(own, s, "right")) - 1
            rules.setdefault(k, []).append((2, s - int(own[k]), e - int(own[k])))
        starts, ends, _ = spans(~_TOKEN[part], own)
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        yield part, own, rules, (np.searchsorted(own, starts, "right") - 1, starts, ends)


def pieces(part: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, start, end) of what the network sees of each candidate, at most INSIDE characters each.

    Overlapping pieces of the whole run and of each part between separators that is long enough; the last piece ends with it.
    """
    low, high, _ = spans((~_TOKEN | _SEPARATOR)[part], own)
    whose = np.searchsorted(starts, low, "right") - 1
    inner = (high - low >= LEAST) & (high - low < (ends - starts)[whose] if len(starts) else False)
    whose = np.concatenate([np.arange(len(starts)), whose[inner]])
    low, high = np.concatenate([starts, low[inner]]), np.concatenate([ends, high[inner]])
    step = INSIDE // 2
    many = 1 + np.maximum(0, -(-(high - low - INSIDE) // step))
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(np.repeat(low, many) + step * turn, np.repeat(np.maximum(low, high - INSIDE), many))
    return np.repeat(whose, many), first, np.minimum(first + INSIDE, np.repeat(high, many))


def windows(part: np.ndarray, own: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the network sees of each candidate: letters before it, in it and after it, each with codes of its own."""
    code = np.full(257, 96, np.int64)
    code[32:127] = np.arange(1, 96)
    code[256] = 0
    out = []
    for low, high, region in (((starts - BEFORE)[:, None] + np.arange(BEFORE), starts, 0), (starts[:, None] + np.arange(INSIDE), ends, 1), (ends[:, None] + np.arange(AFTER), own[rows + 1], 2)):
        inside = (low >= own[rows][:, None]) & (low < high[:, None])
        letters = np.where(inside, part[np.clip(low, 0, max(0, len(part) - 1))].astype(np.int64) if len(part) else 0, 256)
        out.append(code[letters] + _LETTERS * region)
    return np.concatenate(out, axis=1).astype(np.int16)


class Network:
    """Letter vectors, one convolution, maximum and mean over places, a logistic output, a calibrated threshold."""

    WIDTH = 5

    def __init__(self, parameters: list[np.ndarray], threshold: float = 0.5, slope: float = 1.0, shift: float = 0.0):
        self.parameters, self.threshold, self.slope, self.shift = parameters, threshold, slope, shift

    def forward(self, x: np.ndarray):
        letters, kernel, bias, out = self.parameters
        seen = letters[x]
        wide = np.lib.stride_tricks.sliding_window_view(seen, self.WIDTH, axis=1).reshape(len(x), x.shape[1] - self.WIDTH + 1, -1)
        hidden = np.maximum(wide @ kernel + bias, 0)
        top = hidden.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(hidden, top[:, None], axis=1)[:, 0], hidden.mean(axis=1), np.ones((len(x), 1))], axis=1)
        return pooled @ out, (x, wide, hidden, top, pooled)

    def gradients(self, kept, change: np.ndarray) -> list[np.ndarray]:
        letters, kernel, _, out = self.parameters
        x, wide, hidden, top, pooled = kept
        filters = kernel.shape[1]
        on_pooled = change[:, None] * out
        on_hidden = np.repeat(on_pooled[:, None, filters : 2 * filters] / hidden.shape[1], hidden.shape[1], axis=1)
        np.put_along_axis(on_hidden, top[:, None], np.take_along_axis(on_hidden, top[:, None], axis=1) + on_pooled[:, None, :filters], axis=1)
        on_hidden *= hidden > 0
        on_wide = (on_hidden @ kernel.T).reshape(len(x), hidden.shape[1], letters.shape[1], self.WIDTH)
        on_seen = np.zeros((*x.shape, letters.shape[1]))
        for k in range(self.WIDTH):
            on_seen[:, k : k + hidden.shape[1]] += on_wide[..., k]
        on_letters = np.stack([np.bincount(x.ravel(), on_seen[..., d].ravel(), len(letters)) for d in range(letters.shape[1])], axis=1)
        return [on_letters, wide.reshape(-1, wide.shape[2]).T @ on_hidden.reshape(-1, filters), on_hidden.sum(axis=(0, 1)), change @ pooled]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        logits = [self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512)]
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate(logits) + self.shift, -60, 60))) if logits else np.zeros(0)


#: The letters that other secrets are drawn from: hexadecimal in upper case, letters and digits, in one case, with separators.
ALPHABETS = ("0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_")


def redrawn(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows of other secrets in the places of known ones: their letters drawn anew from one of ALPHABETS each, 12 letters at least.

    Rules know few forms; what secrets of all forms share is that nothing in them repeats as in words.
    """
    x = x.copy()
    codes = [np.frombuffer(a.encode(), np.uint8).astype(np.int64) - 31 for a in ALPHABETS]
    size = (x[:, BEFORE : BEFORE + INSIDE] > _LETTERS).sum(axis=1)
    for k, n in enumerate(rng.integers(LEAST, np.maximum(size, LEAST) + 1).tolist()):
        own = codes[rng.integers(len(codes))]
        x[k, BEFORE : BEFORE + INSIDE] = _LETTERS
        x[k, BEFORE : BEFORE + n] = own[rng.integers(len(own), size=n)] + _LETTERS
    return x


#: Words that identifiers and names of files are made of, beside the corpus's own.
NAMES = "abstract account action array base bean builder cache class client config connection context controller count data default document element error event factory field file filter handler helper index input instance item key list manager map message method model module name node number object option order output page parser path policy process property provider proxy query record report request resource response result rule script server service session source state status stream string system table target task test text thread time tree type update user util value vector version view window writer".split()


def harmless(words: list[str], rng: np.random.Generator) -> str:
    """A text that looks like a key and is none: an address, a date, a number, an identifier, a name of a file or of a thing."""
    word = lambda: words[int(rng.integers(len(words)))]
    digits = lambda n: "".join(map(str, rng.integers(10, size=n)))
    low, high = int(rng.integers(1, 10)), int(rng.integers(1990, 2030))
    month, day = f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}"
    date = f"{high}{'-/._'[int(rng.integers(4))]}{month}{'-/._'[int(rng.integers(4))]}{day}"
    join = lambda sign, n: sign.join(word() for _ in range(n))
    ending = ("com", "org", "net", "de", "fr", "es", "io", "co.uk", "html", "jpg", "png", "pdf", "txt", "py", "js", "csv", "zip", "tar.gz")
    some = lambda *of: of[int(rng.integers(len(of)))]
    forms = (
        lambda: f"{some('https://', 'http://', '//')}{some('www.', '', 'cdn.', 'api.')}{word()}.{some(*ending[:8])}/{join('/', int(rng.integers(1, 3)))}/{high}/{month}/{join('-', int(rng.integers(1, 6)))}{some('.html', '', '/', '.php')}",
        lambda: f"{some('https://', 'http://')}{word()}.{some(*ending[:8])}/{word()}/{digits(int(rng.integers(3, 12)))}{some('', '?page=' + str(low), '/' + word())}",
        lambda: "-".join("".join(some(*"0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
        lambda: "".join(str((low + k * some(1, 1, 3, 7)) % 10) for k in range(int(rng.integers(12, 21)))),
        lambda: digits(int(rng.integers(12, 21))),
        lambda: f"{digits(int(rng.integers(1, 4)))}.{digits(int(rng.integers(10, 19)))}",
        lambda: f"{date}{some('T', '_', '-')}{digits(2)}{some('', ':', '-')}{digits(2)}{some('', ':', '-')}{digits(2)}{some('', 'Z', '.' + digits(3) + 'Z')}",
        lambda: f"{some('+', '00', '')}{low}{some('-', '.', '')}{digits(3)}{some('-', '.')}{digits(3)}{some('-', '.')}{digits(4)}",
        lambda: f"10.{digits(4)}/{some(word(), word()[0] + '.' + word(), 'j.' + word())}{some('.', '-')}{high}{some('.', '-')}{digits(int(rng.integers(3, 8)))}",
        lambda: f"97{some('8', '9')}-{low}-{digits(2)}-{digits(6)}-{low}",
        lambda: f"{some('IMG', 'DSC', 'VID', 'PXL', 'Screenshot', word())}{some('_', '-')}{high}{month}{day}{some('_', '-')}{digits(6)}.{some(*ending[8:])}",
        lambda: f"{join(some('_', '-', '.'), int(rng.integers(2, 5)))}{some('', '-v' + str(low), '_' + digits(3), '-' + str(high))}.{some(*ending[8:])}",
        lambda: f"{some('v', '')}{low}.{digits(int(rng.integers(1, 3)))}.{low}-{some('beta', 'alpha', 'rc', 'dev', 'build', 'snapshot')}.{low}{some('', '-' + str(high) + month + day, '+' + digits(8))}",
        lambda: join("_", int(rng.integers(2, 5))) + some("", digits(int(rng.integers(1, 4)))),
        lambda: word() + "".join(word().capitalize() for _ in range(int(rng.integers(1, 4)))) + some("", digits(int(rng.integers(1, 3)))),
        lambda: join("_", int(rng.integers(2, 4))).upper() + some("", "_" + digits(2)),
        lambda: f"{some('', '/', '/usr/lib/', '/home/', 'src/')}{join('/', int(rng.integers(2, 5)))}{some('', str(low), '.' + digits(2))}/{word()}.{some(*ending[8:])}",
        lambda: f"{some('org', 'com', 'net')}.{join('.', int(rng.integers(2, 4)))}.{word().capitalize()}{word().capitalize()}",
        lambda: f"{some('INV', 'ORD', 'REF', 'PO', 'ID', 'SKU', word().upper())}-{high}-{digits(int(rng.integers(4, 9)))}",
        lambda: f"{word()}.{word()}{digits(int(rng.integers(0, 5)))}{some('', '.' + word())}",
        lambda: some(".", "-").join(digits(int(rng.integers(2, 5))) for _ in range(int(rng.integers(4, 7)))),
    )
    return some(*forms)()


def _letters_of(codes: np.ndarray) -> str:
    """The characters of one region of a window, as far as they are ASCII."""
    codes = codes % _LETTERS
    return "".join(chr(c + 31) if c < 96 else "?" for c in codes[codes > 0].tolist())


def _places_of(x: np.ndarray, rng: np.random.Generator) -> list[tuple[str, str]]:
    """What stands before and after some of the candidates of the windows ``x``."""
    return [(_letters_of(w[:BEFORE]), _letters_of(w[BEFORE + INSIDE :])) for w in x[rng.permutation(len(x))[:500]]]


def _words(places: list[tuple[str, str]]) -> list[str]:
    return sorted({w.lower() for a, b in places for w in re.findall("[A-Za-z]{3,12}", f"{a} {b}")}) + NAMES


def harmless_windows(x: np.ndarray, rng: np.random.Generator, many: int) -> np.ndarray:
    """Windows of ``many`` harmless texts at least, of words and in places that the windows ``x`` have."""
    if not len(x):
        return np.zeros((0, BEFORE + INSIDE + AFTER), np.int16)
    places = _places_of(x, rng)
    words, texts = _words(places), []
    for _ in range(many):
        before, after = places[int(rng.integers(len(places)))]
        texts.append(f"{before.rpartition(' ')[0]} {harmless(words, rng)} {after.partition(' ')[2]}".encode())
    data, offsets, out = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), []
    for part, own, _, (rows, starts, ends) in found(data, offsets):
        whose, low, high = pieces(part, own, starts, ends)
        out.append(windows(part, own, rows[whose], low, high))
    return np.concatenate(out)


def behind_paths(x: np.ndarray, others: np.ndarray, rng: np.random.Generator) -> None:
    """Puts the secrets of the windows ``x`` behind paths, addresses and names: what stands before a key there is harmless, the key isn't."""
    words = _words(_places_of(others, rng)) if len(others) else NAMES
    for k in range(len(x)):
        names = [words[int(i)] for i in rng.integers(len(words), size=4)]
        sign = ("/", "/", "=", ".", "-", "_")[int(rng.integers(6))]
        before = ("/".join(names) + sign)[-BEFORE:].encode()
        x[k, :BEFORE] = 0
        x[k, BEFORE - len(before) : BEFORE] = np.frombuffer(before, np.uint8).astype(np.int16) - 31
        x[k, BEFORE + INSIDE :] = 2 * _LETTERS + np.append(np.frombuffer((b" ", b"/", b".")[int(rng.integers(3))], np.uint8).astype(np.int16) - 31, np.zeros(AFTER - 1, np.int16))


def threshold_of_counts(score: np.ndarray, secrets: np.ndarray, others: np.ndarray, recall: float, alarms: float) -> float:
    """What ``threshold_of`` gives for so many secrets and others of each score, ascending ones."""
    passing, alarm = np.cumsum(secrets[::-1])[::-1], np.cumsum(others[::-1])[::-1] / max(1, others.sum())
    options = np.flatnonzero((secrets > 0) & (passing >= np.ceil(recall * secrets.sum() - 1e-9)))
    if not len(options):
        options = np.flatnonzero(secrets > 0)[-1:]
    fits = alarm[options] <= alarms
    errors = np.where(fits, secrets.sum() - passing[options] + alarm[options] * others.sum(), np.inf)
    return float(score[options[int(np.argmin(errors))] if fits.any() else options[-1]])


def threshold_of(score: np.ndarray, truth: np.ndarray, recall: float, alarms: float) -> float:
    """The highest threshold at which a share of ``recall`` of the secrets passes; lower where alarms stay under their bound and more secrets pass.

    Recall comes first. Of the thresholds at which it is reached and at most a share of ``alarms`` of the others passes, that
    with the fewest errors counts.
    """
    positive = np.sort(score[truth == 1])
    highest = positive[int((1 - recall) * len(positive) + 1e-9)]
    options = np.unique(positive[positive <= highest])
    alarm = np.array([(score[truth == 0] >= t).mean() for t in options])
    missed = np.searchsorted(positive, options)
    fits = alarm <= alarms
    errors = np.where(fits, missed + alarm * (truth == 0).sum(), np.inf)
    return float(options[int(np.argmin(errors))] if fits.any() else highest)


def train(x: np.ndarray, y: np.ndarray, recall: float = 0.9, alarms: float = 0.001, rounds: int = 24, dimension: int = 8, filters: int = 32) -> Network:
    """A network from windows ``x`` and labels ``y``; a fifth of the rows is held out for calibration and the threshold.

    Secrets of other forms are learned in the places of those labelled, and harmless texts that look like secrets. At most a
    share of ``alarms`` of all that isn't labelled may pass where recall allows. Without both labels nothing is learned and
    no candidate passes.
    """
    rng = np.random.default_rng(5)
    p = [rng.normal(0, 0.3, (3 * _LETTERS, dimension)), rng.normal(0, 0.15, (dimension * Network.WIDTH, filters)), np.zeros(filters), np.zeros(2 * filters + 1)]
    net = Network(p, threshold=2.0)
    if len(y) < 20 or y.min() == y.max():
        return net
    x, y = enriched(x, y, rng)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    descend(net, x, y, used, rng, [0.01 * 0.05 ** (k / rounds) for k in range(rounds)])
    logit, truth = net.forward(x[held])[0], y[held]
    if truth.min() == truth.max():
        return net
    calibrate(net, logit, truth)
    net.threshold = threshold_of(net.scores(x[held]), truth, recall, alarms)
    return net


def enriched(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``x`` and ``y`` with secrets of other forms and harmless texts, half of the secrets without their context."""
    many = int((y == 1).sum())
    other, benign = redrawn(np.repeat(x[y == 1], max(1, min(4, 2000 // many)), axis=0), rng), harmless_windows(x[y == 0], rng, min(3000, max(500, 8 * many)))
    behind_paths(other[::3], x[y == 0], rng)
    x, y = np.concatenate([x, other, benign]), np.concatenate([y, np.ones(len(other), y.dtype), np.zeros(len(benign), y.dtype)])
    blank = np.flatnonzero((rng.random(len(y)) < 0.5) & (y == 1))
    x[blank, :BEFORE] = 0
    x[blank, BEFORE + INSIDE :] = 2 * _LETTERS
    return x, y


def descend(net: Network, x: np.ndarray, y: np.ndarray, used: np.ndarray, rng: np.random.Generator, steps: list[float]) -> None:
    """Changes the network by the rows ``used``, once for each of ``steps``, the size of a step then; both labels weigh the same."""
    p = net.parameters
    m, v, turn = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for step in steps:
        rng.shuffle(used)
        for k in range(0, len(used), 128):
            rows = used[k : k + 128]
            logit, kept = net.forward(x[rows])
            change = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[rows]) * balance[rows] / len(rows)
            turn += 1
            for i, g in enumerate(net.gradients(kept, change)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p[i] -= step * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.99**turn)) + 1e-8)


def calibrate(net: Network, logit: np.ndarray, truth: np.ndarray, n: np.ndarray | None = None) -> None:
    """Platt scaling of the network's outputs; ``n``: for how many each stands."""
    share = np.full(len(logit), 1 / len(logit)) if n is None else n / n.sum()
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(net.slope * logit + net.shift, -60, 60)))
        net.slope = max(1e-3, net.slope - 0.1 * ((q - truth) * logit * share).sum() / (1 + (logit**2 * share).sum()) * 10)
        net.shift -= 0.1 * ((q - truth) * share).sum()


def _examples(batches):
    for batch in parts(batches, 1):
        seen, labels, digits = [], [], []
        for part, own, rules, (rows, starts, ends) in found(*utf8(batch.column(1))):
            whose, starts, ends = pieces(part, own, starts, ends)
            rows = rows[whose]
            before = np.append(0, np.cumsum((part >= 48) & (part < 58)))
            digits += (before[ends] > before[starts]).tolist()
            seen.append(windows(part, own, rows, starts, ends))
            labels += [_covered(rules.get(k, ()), s - own[k], e - own[k]) for k, s, e in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True)]
        flat = np.concatenate(seen) if seen else np.zeros((0, BEFORE + INSIDE + AFTER), np.int16)
        yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in flat], pa.binary()), pa.array(labels, pa.int32()), pa.array(digits, pa.bool_())], ["seen", "label", "digit"])


def _covered(rules, start: int, end: int) -> int:
    return int(any(s < end and start < e for _, s, e in rules))


#: Candidates that one task learns from; outputs are counted in steps of a part of one; parameters add up in parts of one.
SHARD, FINE, EXACT = 25_000, 256, 1 << 24


def _flat(found, seed: int) -> tuple[np.ndarray, np.ndarray, np.random.Generator]:
    """(windows, labels) of a shard's batches (shard, seen, label), and its random numbers, which its number gives."""
    batches = [b for b in found if b.num_rows]
    if not batches:
        return np.zeros((0, BEFORE + INSIDE + AFTER), np.int16), np.zeros(0, np.int64), np.random.default_rng(seed)
    x = np.concatenate([np.frombuffer(b"".join(b.column(1).to_pylist()), np.int16) for b in batches]).reshape(-1, BEFORE + INSIDE + AFTER)
    y = np.concatenate([b.column(2).to_numpy().astype(np.int64) for b in batches])
    return x, y, np.random.default_rng([seed, batches[0].column(0)[0].as_py()])


def _held() -> Column:
    """True for the fifth of all candidates that ``refined`` doesn't learn from."""
    return F.pmod(F.shiftright(F.xxhash64("seen"), 32), F.lit(5)) == 0


def refined(rows: DataFrame, net: Network, many: int, recall: float = 0.9, alarms: float = 0.001) -> Network:
    """``net`` after it has learned from every one of ``many`` distinct candidates (seen, label), calibrated on those held out.

    Candidates are dealt to shards of about SHARD by a hash of what is seen. Four fifths of a shard change a copy of ``net``,
    and the shards' parameters are averaged by Spark. The outputs for the last fifth of all shards are counted by label, in
    steps of 1 / FINE; calibration and threshold follow from these counts. Both passes add secrets of other forms and harmless
    texts as ``train`` does. Results don't depend on how tasks are dealt: sums are of integers.
    """
    shards = max(1, -(-many // SHARD))
    dealt = rows.select(F.pmod(F.xxhash64("seen"), F.lit(shards)).cast("int").alias("shard"), "seen", "label", _held().alias("held"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("seen", "label")

    def changed(batches):
        x, y, rng = _flat(batches, 7)
        if len(y) < 20 or y.min() == y.max():
            return
        own = Network([p.copy() for p in net.parameters])
        x, y = enriched(x, y, rng)
        descend(own, x, y, np.arange(len(y)), rng, [0.001])
        flat = np.concatenate([p.ravel() for p in own.parameters])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.round(flat * EXACT).astype(np.int64))], ["place", "value"])

    sums = dealt.where("not held").drop("held").mapInArrow(changed, "place long, value long").groupBy("place").agg(F.sum("value").alias("value"), F.count("*").alias("n")).orderBy("place").collect()
    if sums:  # as many rows as the network has parameters
        net = Network(_shaped(np.array([r["value"] / (r["n"] * EXACT) for r in sums])), net.threshold)

    def counted(batches):
        x, y, rng = _flat(batches, 9)
        if not len(y):
            return
        if 0 < y.sum() < len(y):
            x, y = enriched(x, y, rng)
        logit = np.concatenate([net.forward(x[k : k + 512])[0] for k in range(0, len(x), 512)])
        step, n = np.unique(np.floor(np.clip(logit, -60, 60) * FINE).astype(np.int64) * 2 + y, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(step >> 1), pa.array(step & 1), pa.array(n)], ["step", "label", "n"])

    counts = dealt.where("held").drop("held").mapInArrow(counted, "step long, label long, n long").groupBy("step", "label").agg(F.sum("n").alias("n")).orderBy("step", "label").collect()
    truth, n = np.array([r["label"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64)
    if not len(n) or truth.min() == truth.max():
        return net
    logit = np.array([r["step"] for r in counts]) / FINE
    calibrate(net, logit, truth, n)
    own, which = np.unique(logit, return_inverse=True)
    secret, other = (np.bincount(which, np.where(truth == k, n, 0)).astype(np.int64) for k in (1, 0))
    score = 1 / (1 + np.exp(-np.clip(net.slope * own + net.shift, -60, 60)))
    net.threshold = threshold_of_counts(score, secret, other, recall, alarms)
    return net


def _shaped(flat: np.ndarray, dimension: int = 8, filters: int = 32) -> list[np.ndarray]:
    """The parameters of a network of the sizes that ``train`` has, from all their values in a row."""
    shapes = ((3 * _LETTERS, dimension), (dimension * Network.WIDTH, filters), (filters,), (2 * filters + 1,))
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
    return [part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


def _begun(most: int):
    """The network that rows (kind, seen, label, n) begin, as one row, at most ``most`` of each kind with repeated ones; whether both labels are there."""

    def run(batches):
        x, y, left = [], [], {}
        for batch in batches:
            for kind, seen, label, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = min(left.get(kind, most), many)
                x += [np.frombuffer(seen, np.int16)] * n
                y += [label] * n
                left[kind] = left.get(kind, most) - n
        x, y = np.array(x, np.int16).reshape(len(x), BEFORE + INSIDE + AFTER), np.array(y, np.int64)
        net = train(x, y)
        flat = np.concatenate([p.ravel() for p in net.parameters])
        both = len(y) >= 20 and 0 < int(y.sum()) < len(y)
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64())), *(pa.array([float(v)], pa.float64()) for v in (net.threshold, net.slope, net.shift)), pa.array([both], pa.bool_())], ["parameters", "threshold", "slope", "shift", "both"])

    return run


def learned(docs: DataFrame, most: int = 3_000) -> Network:
    """A network from the candidates of all rows, those that share a doc_id or have none too.

    It begins with ``most`` candidates of each label, those with the smallest hashes (of label 0 as many without a digit on
    top: words are so many that few others would be learned). Where there are more, ``refined`` goes over all distinct ones,
    and parameters, calibration and threshold follow from all of them. Null and empty texts have no candidates; in the
    beginning repeated ones count as often as they are there; with too few findings, or in an empty table, nothing is learned
    and rules alone find. A task trains the beginning, so that the driver needs no memory for it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_examples, "seen binary, label int, digit boolean").groupBy("seen", "label", "digit").agg(F.count("*").alias("n"))
    rows = written(found, "candidates")
    kinds = ("label = 0 and digit", "label = 0 and not digit", "label = 1")
    sizes = rows.agg(F.count("*"), *(F.coalesce(F.sum(F.when(F.expr(k), F.col("n"))), F.lit(0)) for k in kinds)).first()
    more = max(sizes[1:]) > most
    usable = rows.where(~_held()) if more else rows
    each = [usable.where(kind).orderBy(F.xxhash64("seen"), "seen").limit(most).select(F.lit(k).alias("kind"), "seen", F.col("label").cast("int").alias("label"), "n") for k, kind in enumerate(kinds)]
    first = reduce(DataFrame.unionByName, each).coalesce(1).sortWithinPartitions("kind", F.xxhash64("seen"), "seen")
    trained = first.mapInArrow(_begun(most), "parameters array<double>, threshold double, slope double, shift double, both boolean").collect()
    if not trained:
        return train(np.zeros((0, BEFORE + INSIDE + AFTER), np.int16), np.zeros(0, np.int64))
    begun = trained[0]
    net = Network(_shaped(np.array(begun["parameters"])), begun["threshold"], begun["slope"], begun["shift"])
    return refined(rows, net, sizes[0]) if more and begun["both"] else net


def candidate_scores(net: Network, part: np.ndarray, own: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 14) -> np.ndarray:
    """The highest score of the pieces of each candidate; windows of ``most`` pieces are in memory at once."""
    whose, low, high = pieces(part, own, starts, ends)
    out = np.zeros(len(starts))
    for k in range(0, len(whose), most):
        now = slice(k, k + most)
        np.maximum.at(out, whose[now], net.scores(windows(part, own, rows[whose[now]], low[now], high[now])))
    return out


def _places(data: np.ndarray, offsets: np.ndarray, net: Network):
    """For each row its spans (kind, start, end) in bytes, by start, then kind; the network's never overlap those of rules."""
    for part, own, rules, (rows, starts, ends) in found(data, offsets):
        score = candidate_scores(net, part, own, rows, starts, ends)
        for k, s, e in zip(rows[score >= net.threshold].tolist(), starts[score >= net.threshold].tolist(), ends[score >= net.threshold].tolist(), strict=True):
            s, e = s - int(own[k]), e - int(own[k])
            if not _covered([r for r in rules.get(k, ()) if r[0] < 3], s, e):
                rules.setdefault(k, []).append((3, s, e))
        for k in range(len(own) - 1):
            yield part[own[k] : own[k + 1]], sorted(rules.get(k, ()), key=lambda r: (r[1], r[0], r[2]))


def _scanned(net: Network):
    def run(batches):
        for batch in parts(batches, 1):
            columns: list[list] = [[], [], [], [], []]
            for part, places in _places(*utf8(batch.column(1)), net):
                if places:
                    point = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                    places = [(k, int(point[s]), int(point[e])) for k, s, e in places]
                text = [f"{KINDS[k]}:{s}:{e}" for k, s, e in places]
                base = ",".join(t for t, (k, _, _) in zip(text, places, strict=True) if k < 3)
                for k in range(3):
                    columns[k].append(sum(p[0] == k for p in places))
                columns[3].append(hashlib.sha256(base.encode()).hexdigest())
                columns[4].append(",".join(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs`` (doc_id, text, ...).

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind: what rules find, and as ``model``
    what the network adds. Null and empty texts have none; repeated rows are scanned alike; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scanned(net), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, net: Network, mask: bytes = b"[secret]") -> DataFrame:
    """All rows and columns of ``docs`` with each span replaced by ``mask``, overlapping ones together, and n_chars to match.

    Rows without a span, null texts among them, stay as they are.
    """
    text_at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    size_type = None if size_at is None else docs.schema[size_at].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in parts(batches, text_at):
            texts, sizes = batch.column(text_at).to_pylist(), None if size_at is None else batch.column(size_at).to_pylist()
            for k, (part, places) in enumerate(_places(*utf8(batch.column(text_at)), net)):
                if not places:
                    continue
                out, at = [], 0
                for _, s, e in places:
                    if s >= at:
                        out += [part[at:s].tobytes(), mask]
                    at = max(at, e)
                texts[k] = b"".join([*out, part[at:].tobytes()]).decode("utf-8", "replace")
                if sizes is not None:
                    sizes[k] = len(texts[k])
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if sizes is not None:
                columns[size_at] = pa.array(sizes, to_arrow_type(size_type))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learned(docs))
