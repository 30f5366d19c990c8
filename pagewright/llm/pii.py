"""PII: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Texts are cut into overlapping windows; each is decoded by Viterbi, and the spans of all windows of a text are reconciled.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.columns import named, numbered, others

KINDS = ("NONE", "EMAIL", "PHONE", "IP", "CARD", "ID", "SECRET")
HIDDEN = 12
WINDOW, OVERLAP, BATCH = 512, 64, 3072
K = len(KINDS)
_PAD, _OTHER = 0, 1


def _symbols() -> np.ndarray:
    table = np.full(0x300, _OTHER, np.uint8)
    for cp in range(32, 127):
        table[cp] = cp
    for cp in (9, 10, 13):
        table[cp] = 10
    for cp in range(0xC0, 0x300):
        if chr(cp).isalpha():
            table[cp] = 2 if chr(cp).islower() else 3
    return table


_SYMBOLS = _symbols()
ALPHABET = 128


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOLS[np.minimum(points, 0x2FF)]


# ---- labelled spans to learn from


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(r: random.Random) -> str:
    body = r.choice(("4", "4", "4", "51", "52", "53", "54", "55", "6011", "34", "37"))
    size = 15 if body[0] == "3" else 16
    body += "".join(r.choice("0123456789") for _ in range(size - 1 - len(body)))
    body += next(c for c in "0123456789" if luhn(body + c))
    sep = r.choice(("", "", "", " ", "-"))
    if r.random() < 0.4:  # numbers of that shape; the check digit decides later
        body = _digits(r, 16)
    return sep.join(body[k : k + 4] for k in range(0, size, 4)) if sep else body


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _of(r: random.Random, signs: str, n: int) -> str:
    return "".join(r.choice(signs) for _ in range(n))


_HEX, _UP, _LOW = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SYLLABLES = "th er on an in re nd ti es or ha ed it at en st ou ing sch ver ung lich ein ä ü ö ß é è ê ç eau oi tion ment ción ado ñ í ó que ll ar bo mi".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def entity(r: random.Random) -> tuple[str, str, str, str]:
    """(kind, text before, private text, text after)."""
    kind = r.choice(("EMAIL", "EMAIL", "PHONE", "PHONE", "PHONE", "IP", "IP", "CARD", "CARD", "ID", "ID", "ID", "SECRET", "SECRET", "SECRET"))
    if kind == "EMAIL":
        local = r.choice((word(r), word(r) + r.choice("._-+") + word(r), word(r) + "." + _digits(r, 2), _of(r, _LOW, r.randint(1, 9)) + r.choice(("", _digits(r, r.randint(1, 4))))))
        host = r.choice((f"mail{r.randint(0, 99)}.example.com", f"{_of(r, _LOW, r.randint(3, 10))}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'edu'))}", f"{word(r)}-{word(r)}.example.{r.choice(('org', 'net', 'com'))}"))
        return kind, "", f"{local}@{host}", ""
    if kind == "PHONE":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return kind, "", r.choice((f"+1 ({a}) 555-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(20, 99)} {_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", f"+{r.randint(20, 99)} {_digits(r, 3)} {_digits(r, 7)}", f"+{r.randint(20, 99)}{_digits(r, 10)}", f"00{r.randint(20, 99)} {_digits(r, 2)} {_digits(r, 7)}")), ""
    if kind == "IP":
        most, first = r.choice((255, 255, 255, 20)), r.choice(([], [], [], ["10", "0"], ["192", "168"]))
        return kind, "", ".".join([*first, *(str(r.randint(0, most)) for _ in range(4 - len(first)))]), ""
    if kind == "CARD":
        return kind, "", _card(r), ""
    if kind == "ID":
        return kind, "", r.choice((f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", f"{_of(r, _UP, 2)}{_digits(r, 2)}{_digits(r, r.randint(14, 20))}", f"{_of(r, _UP, 2)}{_digits(r, 2)} " + " ".join(_digits(r, 4) for _ in range(4)) + r.choice(("", " " + _digits(r, 2))))), ""
    name = r.choice(("token", "password", "secret", "api_key", "key", "pwd", "passwd", "auth", "access_token"))
    if r.random() < 0.5:
        name = name.upper() if r.random() < 0.3 else name
        value = r.choice((_of(r, _HEX, r.choice((16, 18, 20, 32, 40, 40, 64))), _of(r, _HEX, 40), _of(r, _HEX, 18), _of(r, _HEX + _LOW + _UP, r.randint(14, 40))))
        return kind, *r.choice(((f'{name} = "', value, '"'), (f"{name}=", value, ""), (f"{name}: ", value, ""), (f'"{name}": "', value, '"'), (f"{name}='", value, "'")))
    value = r.choice(("AKIA" + _of(r, _UP + "234567", 16), "AKIA" + _of(r, _UP + "0123456789", 16), "ghp_" + _of(r, _LOW + _UP + "0123456789", 36), "sk-" + _of(r, _LOW + _UP + "0123456789", r.randint(24, 48)), _of(r, _HEX, 40), "xoxb-" + _digits(r, 11) + "-" + _of(r, _LOW + _UP + "0123456789", 24)))
    return kind, "", value, ""


def harmless(r: random.Random) -> str:
    """What looks like private data and isn't."""
    return r.choice(
        (
            _digits(r, r.randint(1, 9)), _digits(r, r.randint(1, 9)), f"{r.randint(1, 12)}.{r.randint(0, 9)}", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}",
            f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", f"{r.randint(0, 23)}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", f"{r.randint(1, 999)},{r.randint(0, 999):03}.{r.randint(0, 99):02}",
            f"@{word(r)}", f"{word(r)} @ {word(r)}", f"https://{word(r)}.example.com/{word(r)}/{r.randint(1, 9999)}?page={r.randint(1, 9)}", f"{r.randint(1, 100)}%", f"#{_of(r, _HEX, 6)}", f"v{r.randint(0, 9)}.{r.randint(0, 9)}", f"{word(r)}={r.randint(0, 999)}", f"{word(r)} = {word(r)}",
            f"{word(r)}_{word(r)}", f"({r.randint(1, 999)})", f"{r.randint(1, 99)}-{r.randint(1, 99)}", f"{_of(r, _UP, r.randint(2, 8))}-{_digits(r, r.randint(1, 4))}", f"pages {r.randint(1, 400)}-{r.randint(401, 999)}", f"ISBN {_digits(r, 3)}-{_digits(r, 1)}-{_digits(r, 4)}", _of(r, _UP, r.randint(3, 24)), _of(r, _LOW, r.randint(10, 30)),
            f"password: {word(r)}", f"token {word(r)}", f'key = "{word(r)} {word(r)}"', f"No. {_digits(r, r.randint(3, 8))}", f"Version {r.randint(1, 4)}.{r.randint(0, 9)}", f"{_digits(r, r.randint(17, 24))}",
        )
    )


def labelled_text(r: random.Random, size: int) -> tuple[str, np.ndarray]:
    """A text of ``size`` characters and the kind of each."""
    style = r.random()
    parts: list[tuple[str, int]] = []
    total = 0
    rate, odd = (0.0, 0.05) if r.random() < 0.2 else (0.12, 0.12)
    while total < size + 80:
        x = r.random()
        if x < rate:
            kind, before, private, after = entity(r)
            own = [(before, 0), (private, KINDS.index(kind)), (after, 0)]
        elif x < rate + odd:
            own = [(harmless(r), 0)]
        else:
            w = word(r)
            own = [(w.capitalize() if r.random() < 0.15 else w, 0)]
        if style < 0.12:
            own = [(t.upper(), k) for t, k in own] + [("!!", 0)]
        elif style < 0.24:
            own.append((r.choice(("***", "###", "%%%", "&&&", "$$$")), 0))
        elif r.random() < 0.15:
            own.append((r.choice((".", ",", ";", ":", ")", "!")), 0))
        own.append((" | " if 0.24 <= style < 0.32 and r.random() < 0.6 else "\n" if r.random() < 0.08 else " ", 0))
        parts += own
        total += sum(len(t) for t, _ in own)
    text = "".join(t for t, _ in parts)
    labels = np.repeat(np.array([k for _, k in parts]), [len(t) for t, _ in parts])
    at = r.randint(0, len(text) - size)
    return text[at : at + size], labels[at : at + size]


# ---- the model


class Tagger:
    """Weights: per direction an input table (A, 3H) and recurrent matrix (3H, H); emissions (2, K, H) + bias; transitions (K, K).

    Each cell couples its input and forget gates (c += i * (g - c)); gates are (tanh + 1) / 2, so that one tanh serves all.
    """

    NAMES = ("table", "recurrent", "out", "bias", "transitions")

    def __init__(self, **weights: np.ndarray):
        for name in self.NAMES:
            setattr(self, name, weights[name])

    @staticmethod
    def start(seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        f = np.float32
        return Tagger(
            table=rng.normal(0, 0.3, (2, ALPHABET, 3 * HIDDEN)).astype(f), recurrent=rng.normal(0, 0.25, (2, 3 * HIDDEN, HIDDEN)).astype(f),
            out=rng.normal(0, 0.3, (2, K, HIDDEN)).astype(f), bias=np.array([1.0] + [0.0] * (K - 1), f), transitions=np.zeros((K, K), f),
        )

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(T, K, B) scores of symbols (T, B)."""
        n, b = ids.shape
        h, c = np.zeros((2, HIDDEN, b), np.float32), np.zeros((2, HIDDEN, b), np.float32)
        z = np.empty((2, 3 * HIDDEN, b), np.float32)
        e = np.empty((n, K, b), np.float32)
        e[:] = self.bias[None, :, None]
        part = np.empty((2, K, b), np.float32)
        for t in range(n):
            np.matmul(self.recurrent, h, out=z)
            z[0] += self.table[0].take(ids[t], axis=0).T
            z[1] += self.table[1].take(ids[n - 1 - t], axis=0).T
            np.tanh(z, out=z)
            gates, g = z[:, : 2 * HIDDEN], z[:, 2 * HIDDEN :]
            gates *= 0.5
            gates += 0.5
            g -= c
            g *= z[:, :HIDDEN]
            c += g
            np.tanh(c, out=h)
            h *= z[:, HIDDEN : 2 * HIDDEN]
            np.matmul(self.out, h, out=part)
            e[t] += part[0]
            e[n - 1 - t] += part[1]
        return e

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the labels (T, B), averaged over characters, and its gradients."""
        n, b = ids.shape
        grads = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        e = np.empty((n, K, b), np.float32)
        e[:] = self.bias[None, :, None]
        kept = []
        for d in range(2):
            own = ids if d == 0 else ids[::-1]
            h, c = np.zeros((HIDDEN, b), np.float32), np.zeros((HIDDEN, b), np.float32)
            steps = []
            for t in range(n):
                a = np.tanh(self.recurrent[d] @ h + self.table[d].take(own[t], axis=0).T)
                i, o, g = 0.5 + 0.5 * a[:HIDDEN], 0.5 + 0.5 * a[HIDDEN : 2 * HIDDEN], a[2 * HIDDEN :]
                c2 = c + i * (g - c)
                tc = np.tanh(c2)
                steps.append((h, c, a, i, o, g, tc))
                h, c = tc * o, c2
                e[t if d == 0 else n - 1 - t] += self.out[d] @ h
            kept.append(steps)
        loss, de, grads["transitions"] = self._crf(e, gold)
        grads["bias"] = de.sum(axis=(0, 2))
        for d in range(2):
            own = ids if d == 0 else ids[::-1]
            dh_next, dc_next = np.zeros((HIDDEN, b), np.float32), np.zeros((HIDDEN, b), np.float32)
            da_all = np.empty((n, 3 * HIDDEN, b), np.float32)
            for t in range(n - 1, -1, -1):
                h0, c0, a, i, o, g, tc = kept[d][t]
                det = de[t if d == 0 else n - 1 - t]
                grads["out"][d] += det @ (tc * o).T
                dh = self.out[d].T @ det + dh_next
                dc = dh * o * (1 - tc * tc) + dc_next
                da = da_all[t]
                da[:HIDDEN] = dc * (g - c0) * 0.5
                da[HIDDEN : 2 * HIDDEN] = dh * tc * 0.5
                da[2 * HIDDEN :] = dc * i
                da *= 1 - a * a
                grads["recurrent"][d] += da @ h0.T
                dh_next = self.recurrent[d].T @ da
                dc_next = dc * (1 - i)
            flat = da_all.transpose(0, 2, 1).reshape(n * b, 3 * HIDDEN)
            order = np.argsort(own.ravel(), kind="stable")
            sorted_ids = own.ravel()[order]
            at = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
            grads["table"][d][sorted_ids[at]] = np.add.reduceat(flat[order], at, axis=0)
        return loss, grads

    def _crf(self, e: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, _, b = e.shape
        move = np.exp(self.transitions + _ALLOWED)
        top = e.max(axis=1, keepdims=True)
        p = np.exp(e - top)
        forward, backward = np.empty_like(e), np.empty_like(e)
        scale = np.empty((n, b), np.float32)
        f = p[0]
        for t in range(n):
            if t:
                f = (move.T @ f) * p[t]
            scale[t] = f.sum(axis=0)
            f = f / scale[t]
            forward[t] = f
        g = np.ones((K, b), np.float32)
        dmove = np.zeros((K, K), np.float32)
        backward[n - 1] = g
        for t in range(n - 1, 0, -1):
            x = g * p[t] / scale[t]
            dmove += forward[t - 1] @ x.T
            g = move @ x
            backward[t - 1] = g
        marginal = forward * backward
        log_z = float((np.log(scale) + top[:, 0]).sum())
        cols = np.arange(b)
        score = float(sum(e[t, gold[t], cols].sum() for t in range(n)) + (self.transitions + _ALLOWED)[gold[:-1], gold[1:]].sum())
        de = marginal
        for t in range(n):
            de[t, gold[t], cols] -= 1
        dt = dmove * move
        np.subtract.at(dt, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        return (log_z - score) / (n * b), de / (n * b), np.where(_ALLOWED < 0, 0, dt) / (n * b)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best kinds (T, B). Windows in which no run of a kind can pay for itself are all NONE without a search."""
        e = self.emissions(ids)
        a = self.transitions
        none, into, out, stay = a[0, 0], a[0, 1:, None], a[1:, 0, None], np.diag(a)[1:, None]
        # What a run of a kind can gain over NONE at most: all its positive steps, and entering and leaving once.
        gain = e[:, 1:] - e[:, :1]
        gain += stay - none
        whole = gain.sum(axis=0) + none - stay  # a run of the whole window: entered and left nowhere
        top = gain.max(axis=0)
        positive = np.maximum(gain, 0, out=gain).sum(axis=0)
        ends = np.maximum.reduce([into + out - stay - none, out - stay, into - stay])
        hot = np.flatnonzero(((np.where(positive > 0, positive, top) + ends > 0) | (whole > 0)).any(axis=0))
        best = np.zeros(ids.shape, np.uint8)
        if not len(hot):
            return best
        e = np.ascontiguousarray(e[:, :, hot])
        n, m = len(e), len(hot)
        entered, left = np.zeros((n, K - 1, m), bool), np.zeros((n, m), np.uint8)
        v0, v = e[0, 0].copy(), e[0, 1:].copy()
        for t in range(1, n):
            ends = v + out
            which = ends.argmax(axis=0)
            end = np.take_along_axis(ends, which[None], 0)[0]
            come, keep = v0 + into, v + stay
            entered[t] = come > keep
            left[t] = np.where(end > v0 + none, which + 1, 0)
            v0 = np.maximum(v0 + none, end) + e[t, 0]
            v = np.maximum(come, keep) + e[t, 1:]
        path = np.empty((n, m), np.uint8)
        state = np.where(v.max(axis=0) > v0, v.argmax(axis=0) + 1, 0)
        cols = np.arange(m)
        for t in range(n - 1, -1, -1):
            path[t] = state
            state = np.where(state == 0, left[t], np.where(entered[t, np.maximum(state, 1) - 1, cols], 0, state))
        best[:, hot] = path
        return best


#: From NONE to any kind, from a kind to itself or NONE; not between kinds.
_ALLOWED = np.where((np.arange(K)[:, None] == np.arange(K)) | (np.arange(K)[:, None] == 0) | (np.arange(K) == 0), 0.0, -30.0).astype(np.float32)


def fit(seed: int = 11, steps: int = 1200, batch: int = 48, size: int = 128, rate: float = 0.02) -> Tagger:
    """Learn from ``steps`` batches of labelled spans, with Adam."""
    r = random.Random(seed)
    model = Tagger.start(seed)
    m = {k: np.zeros_like(getattr(model, k)) for k in Tagger.NAMES}
    v = {k: np.zeros_like(getattr(model, k)) for k in Tagger.NAMES}
    for step in range(1, steps + 1):
        ids, gold = np.zeros((size, batch), np.int64), np.zeros((size, batch), np.int64)
        for k in range(batch):
            n = size if r.random() < 0.8 else r.randint(8, size)
            text, labels = labelled_text(r, n)
            ids[:n, k], gold[:n, k] = encode(text), labels
        _, grads = model.gradients(ids, gold)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        lr = rate * min(1, step / 30) * (1 - 0.95 * step / steps) * min(1.0, 0.5 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * min(1.0, 0.5 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            step_size = lr * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            setattr(model, k, (getattr(model, k) - step_size * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32))
    return model


@functools.lru_cache(maxsize=1)
def default_model() -> Tagger:
    """The model of the production parameters; learned once in a session."""
    return fit()


# ---- spans of texts


_SETS = {
    "EMAIL": frozenset("@._-+%0123456789" + _LOW + _UP), "PHONE": frozenset("0123456789"), "IP": frozenset("0123456789."), "CARD": frozenset("0123456789"),
    "ID": frozenset("0123456789" + _UP), "SECRET": frozenset("_-0123456789" + _LOW + _UP),
}


def accepted(kind: str, text: str) -> bool:
    """Whether a span has the form that its kind must have (a card's check digit, four numbers of an address, …)."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "CARD":
        issuer = digits[0] == "4" or "51" <= digits[:2] <= "55" or "2221" <= digits[:4] <= "2720" or digits[:2] in ("34", "37", "65") or digits[:4] == "6011"
        return 13 <= len(digits) <= 19 and issuer and luhn(digits)
    if kind == "IP":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts)
    if kind == "EMAIL":
        local, _, host = text.partition("@")
        return bool(local) and "." in host.strip(".") and "@" not in host
    if kind == "PHONE":
        return 10 <= len(digits) <= 15
    if kind == "ID":
        return 9 <= len(digits) and (len(digits) == 9 and text.count("-") == 2 or text[:2].isalpha())
    return len(text) >= 12 and any(c.isalpha() for c in text) and (bool(digits) or text.startswith("AKIA") and len(text) == 20)


def reconcile(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """One ordered list of disjoint spans from those that the windows own: each is widened to the whole run of signs of its kind,
    those of a kind that touch are joined, and where kinds disagree the longest span stays (the first of equals)."""
    wide = []
    for start, end, k in found:
        kind = KINDS[k]
        signs = _SETS[kind]
        while start < end and text[start] not in signs and text[start] not in "(+" and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start >= end:
            continue
        wordy = kind == "EMAIL"
        while start > 0 and (text[start - 1] in signs or wordy and text[start - 1].isalnum()):
            start -= 1
        while end < len(text) and (text[end] in signs or wordy and text[end].isalnum()):
            end += 1
        while start < end and text[start] in "._-%" and kind != "PHONE":
            start += 1
        while end > start and text[end - 1] in "._-%+":
            end -= 1
        wide.append((start, end, kind))
    joined: list[list] = []
    for start, end, kind in sorted(wide):
        last = joined[-1] if joined else None
        if last and last[2] == kind and start <= last[1]:
            last[1] = max(last[1], end)
        else:
            joined.append([start, end, kind])
    kept: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(joined, key=lambda s: (s[0] - s[1], s[0])):
        if accepted(kind, text[start:end]) and all(end <= a or b <= start for a, b, _ in kept):
            kept.append((start, end, kind))
    return sorted(kept)


def owned(a: int, b: int, nth: int, count: int) -> bool:
    """Whether a window's span counts: where two windows overlap, the one decides in which the span's middle is farther from the edge, as it sees more around it.
    Of a span that one of them sees only a part of, the middles of both parts can't be the other's."""
    half = OVERLAP // 2
    return (nth == 0 or a + b >= 2 * half) and (nth == count - 1 or a + b < 2 * (WINDOW - half))


def spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of what is private in each text, in characters."""
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lengths) - lengths
    symbols = encode("".join(texts))
    stride = WINDOW - OVERLAP
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // stride)), 0)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * stride
    size = np.minimum(WINDOW, lengths[owner] - start)
    found: dict[int, list[tuple[int, int, int]]] = {}
    order = np.argsort(-size, kind="stable")
    for k in range(0, len(order), BATCH):
        part = order[k : k + BATCH]
        longest = int(size[part[0]])
        index = np.arange(longest)[:, None]
        inside = index < size[part]
        ids = np.where(inside, symbols[np.minimum((base[owner[part]] + start[part]) + index, len(symbols) - 1)], _PAD)
        best = np.where(inside, model.decode(ids), 0).T
        rows = np.flatnonzero(best.any(axis=1))
        for row in rows:
            line = best[row]
            cut = np.flatnonzero(np.diff(line)) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, longest]):
                if line[a]:
                    w = part[row]
                    if owned(int(a), int(b), int(nth[w]), int(count[owner[w]])):
                        found.setdefault(int(owner[w]), []).append((int(start[w] + a), int(start[w] + b), int(line[a])))
    return [reconcile(t, found[i]) if i in found else [] for i, t in enumerate(texts)]


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*parts, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
CHUNK = 3 << 20


def redact(docs: DataFrame, model: Tagger | None = None, column: str = "text") -> DataFrame:
    """Every row, with what is private in ``column`` replaced by its kind in brackets, and ``pii_spans`` (start, end, kind;
    characters of the original text, in order). One pass without a shuffle over whole texts, in windows that overlap.

    Null text: stays null, spans null. Empty text: no spans. Repeated rows are treated alike. Other columns are kept, whatever their names;
    a column named ``pii_spans``, in whatever case, is replaced. An empty table gives an empty result.
    """
    rest = others(docs.columns, ("pii_spans",))
    return named(_redacted(numbered(docs, rest), rest.index(column), model), rest, "pii_spans")


def _redacted(docs: DataFrame, at: int, model: Tagger | None) -> DataFrame:
    """Numbered columns, with the one at ``at`` redacted, and pii_spans."""
    model = model or default_model()
    shared = docs.sparkSession.sparkContext.broadcast({k: getattr(model, k) for k in Tagger.NAMES})
    names = docs.columns
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(**shared.value)
        for batch in batches:
            done = 0
            sizes = np.cumsum([len(x) if x else 0 for x in batch.column(at).to_pylist()])
            while done < batch.num_rows:
                upto = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + CHUNK, "right")))
                piece = batch.slice(done, upto - done)
                done = upto
                texts = piece.column(at).to_pylist()
                found = spans(own, [t or "" for t in texts])
                new = [redacted(t, f) if f else t for t, f in zip(texts, found)]
                told = [None if t is None else [{"start": a, "end": b, "kind": k} for a, b, k in f] for t, f in zip(texts, found)]
                columns = [pa.array(new, c.type) if k == at else c for k, c in enumerate(piece.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(told, arrow_spans)], [*names, "pii_spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii_spans", SPANS)]))


def anonymise(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Documents with redacted texts and their new n_chars; all their columns are kept, whatever their names."""
    at = docs.columns.index("text")
    found = _redacted(numbered(docs, docs.columns), at, model)
    return found.select(*[F.length(f"c{at}").cast("bigint").alias(c) if c == "n_chars" else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
