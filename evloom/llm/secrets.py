"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

One pass over whole texts finds the pattern spans and the candidates outside of them: runs of SHORT or
more key characters with a digit or with letters of mixed case, of four words or more joined by marks, or
with a key word before them. (A run of letters of one case with no key word in the BEFORE characters before it
is taken for a word, however long.) The network slides over a whole candidate, in steps of STEP, and its largest
score counts. It is trained on labels that don't come from what it scores: pattern spans as positives, and
made-up findings by family, secret (keys, tokens, passwords, passphrases behind key words) and clean (UUIDs,
long words, names in camel case, hyphenated words, paths, images and so on). Its threshold is the highest
that keeps the asked recall over all pattern spans of the data that are held back from training, and over
each family of secrets apart from those it was fitted on. Pattern spans always stay; the network adds
spans of kind `cnn`.
"""

from __future__ import annotations

import hashlib
import logging
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices, texts_of
from .common import durable, small_batches

KINDS = ("assign", "access", "hex", "cnn")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # whole runs, as [0-9a-f]+ gives them, of 24 or more
#: The least characters of a candidate.
SHORT = 6
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % SHORT)
#: A digit, letters of mixed case (more than a capital in front), or four words or more joined by marks.
MIXED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z][A-Z]+[a-z]|(?:[A-Za-z]+[-_.+=]){3}[A-Za-z]")
KEY = re.compile(r"pass|pwd|secret|token|key|auth|cred|login|bearer", re.I)
#: Characters of a window: before the candidate, of the candidate, behind it.
BEFORE, OWN, BEHIND = 24, 40, 8
WIDTH = BEFORE + OWN + BEHIND
#: Characters between two windows of a candidate of more than OWN characters, and the windows scored at a time.
STEP, SCORED = 8, 1 << 12
#: Synthetic findings of each family that the network is fitted on, and others that measure it.
SYNTHETIC, APART = 320, 200
#: The recall that the threshold keeps in each family of secrets.
FAMILY_RECALL = 0.95
#: Bins of the threshold's histogram, over log odds from -35 to 35.
BINS = 7000
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base string, starts array<long>, ends array<long>, stretches array<string>, positive array<string>"
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, in order; leftmost non-overlapping within a kind."""
    out, low = [], text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def stretch(text: str, start: int, end: int) -> str:
    """The whole candidate in its surroundings; parts that are too short are filled with NUL."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    return before + text[start:end].ljust(OWN, "\0") + text[end : end + BEHIND].ljust(BEHIND, "\0")


def places(n: int) -> list[int]:
    """Where the windows of a stretch of n characters start; the last one ends with it."""
    last = n - WIDTH
    return [*range(0, last, STEP), last]


def window(text: str, start: int, end: int) -> str:
    """The first window of a candidate."""
    return stretch(text, start, end)[:WIDTH]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of candidates that overlap no pattern span (these in order)."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        if MIXED.search(m[0]) or KEY.search(text, max(0, m.start() - BEFORE), m.start()):
            while k < len(spans) and spans[k][0] < m.end():
                reach = max(reach, spans[k][2])
                k += 1
            if reach <= m.start():
                out.append(m.span())
    return out


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FOUND's columns for every row: pattern spans, candidates and the windows of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, text in zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True):
                    spans = base_spans(text)
                    more = candidates(text, spans)
                    positive = []
                    for s, k, e in spans:
                        at = ASSIGN.match(text, s).start(2) if k == 0 else s
                        positive.append(window(text, at, e))
                    n = [sum(k == j for _, k, _ in spans) for j in range(3)]
                    rows.append((i, *n, written(spans), [s for s, _ in more], [e for _, e in more], [stretch(text, s, e) for s, e in more], positive))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.string())] * 2
                names = [x.split()[0] for x in FOUND.split(", ")]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, FOUND)


def codes(windows: list[str]) -> np.ndarray:
    """ASCII codes; 1 for any other character."""
    out = np.array([[ord(c) for c in w] for w in windows], np.int64).reshape(-1, WIDTH)
    return np.where(out < 128, out, 1)


def codes_of(x: str) -> np.ndarray:
    out = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(out < 128, out, 1)


@dataclass
class Network:
    """Embedding, one convolution, maxima over the three parts of the window, one logistic unit."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0  # over 1: adds nothing
    precision: float = 0.0  # at the threshold, of the held-out windows of training

    KERNEL = 5
    PARTS = ((0, BEFORE), (BEFORE, BEFORE + OWN), (BEFORE + OWN, WIDTH))

    @classmethod
    def new(cls, seed: int = 11, dim: int = 8, filters: int = 40, kind: type = np.float32) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(kind)
        return cls(rng.normal(0, 0.3, (128, dim)).astype(kind), draw(cls.KERNEL * dim, filters), np.zeros(filters, kind), draw(3 * filters), np.zeros(1, kind))

    def forward(self, x: np.ndarray) -> tuple:
        e = np.pad(self.embed[x], ((0, 0), (2, 2), (0, 0)))
        cols = np.concatenate([e[:, j : j + WIDTH] for j in range(self.KERNEL)], 2)
        h = np.maximum(cols @ self.conv + self.conv_bias, 0)
        best = [h[:, a:b].argmax(1) + a for a, b in self.PARTS]
        pooled = np.concatenate([np.take_along_axis(h, b[:, None], 1)[:, 0] for b in best], 1)
        return cols, h, best, pooled, pooled @ self.out + self.out_bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[lo : lo + 512])[-1] for lo in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -35, 35)))

    def scores(self, stretches: list[str]) -> np.ndarray:
        """The largest probability of each stretch's windows."""
        out = np.zeros(len(stretches))
        held, owner, n = [], [], 0
        for i, x in enumerate(stretches):
            row = codes_of(x)
            at = np.array(places(len(row)))
            for lo in range(0, len(at), SCORED):
                part = at[lo : lo + SCORED]
                held.append(np.lib.stride_tricks.sliding_window_view(row, WIDTH)[part])
                owner.append(np.full(len(part), i))
                n += len(part)
                if n >= SCORED:
                    np.maximum.at(out, np.concatenate(owner), self.probability(np.concatenate(held)))
                    held, owner, n = [], [], 0
        if n:
            np.maximum.at(out, np.concatenate(owner), self.probability(np.concatenate(held)))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        cols, h, best, pooled, z = self.forward(x)
        dz = w * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / w.sum()
        dp = dz[:, None] * self.out
        dh = np.zeros_like(h)
        f = h.shape[2]
        for j, b in enumerate(best):
            np.put_along_axis(dh, b[:, None], dp[:, None, j * f : (j + 1) * f], 1)
        dh *= h > 0
        dcols = dh @ self.conv.T
        dim = self.embed.shape[1]
        de = np.zeros((len(x), WIDTH + 4, dim), self.embed.dtype)
        for j in range(self.KERNEL):
            de[:, j : j + WIDTH] += dcols[:, :, j * dim : (j + 1) * dim]
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, x, de[:, 2:-2])
        return [dembed, np.tensordot(cols, dh, ([0, 1], [0, 1])), dh.sum((0, 1)), pooled.T @ dz, np.array([dz.sum()])]


#: Frequent letter groups of several languages, of which made-up long words consist.
GROUPS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ung sch ein ich der ver gen ent ion tion ment ous ent que les des eur ais oir aux ado dad ción os las ar mente ñ ó é ü ä".split()
#: Families of made-up findings, secret and clean, and of surroundings. Hexadecimal ones are shorter than the pattern's.
SECRET = ("hex", "alnum", "base64", "letters", "one case", "upper and digits", "short", "leet", "passphrase")
#: Secret behind a key word alone: anywhere else these are words.
TOLD = ("one case", "short", "passphrase")
CLEAN = ("number", "date", "version", "host", "url", "path", "camel", "long word", "capitals", "snake", "hyphens", "word and number", "uuid", "data image", "name")
NAMED = ["pwd: ", "pass=", "pw ", "key = ", "key: '", "passphrase is ", "Bearer ", "auth ", "auth: ", "://u:", "://admin:", "login ", "login: ", "cred: ", 'private_key "', "pass phrase: "]
USUAL = ["the key ", "a password is ", "login at ", "keys to ", "see ", "on ", "://", "@", "id ", "no. ", "(", "request ", "session id: ", "trace ", "", "", "", ""]


def made_up(seed: int) -> dict[str, Callable[[], str]]:
    """A maker of values for each family."""
    rng = random.Random(seed)
    pick = lambda k, a: "".join(rng.choice(a) for _ in range(k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    onset = [*"bcdfghjklmnprstvwz", "", "", *"ch sch st sp tr br gr cl pl th wh qu pf tz kn bl fl sl sm sn sw tw dr cr fr pr str scr thr spr sh".split()]
    vowel, coda = [*"aeiou" * 3, "y", *"ei ie ai ou au ea eu io".split()], ["", "", "", *"n r s t l ng nt st ch cht tz rt ss ll ment tion".split()]
    ascii_groups = [g for g in GROUPS if g.isascii()]

    def word(least: int = 1, most: int = 4) -> str:
        if rng.random() < 0.4:
            return "".join(rng.choice(ascii_groups) for _ in range(rng.randint(least, most) + 1))
        return "".join(rng.choice(onset) + rng.choice(vowel) + rng.choice(coda) for _ in range(rng.randint(least, most)))

    number = lambda most: str(rng.randrange(10 ** rng.randint(1, most)))

    def leet() -> str:
        x = list(word(2, 5).title() + word(1, 2).title())
        for j in range(1, len(x)):
            x[j] = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(x[j], x[j]) if rng.random() < 0.7 else x[j]
        return "".join(x) + number(3)

    def path() -> str:
        return "/".join(word() + rng.choice(["", "", number(3), "-" + word(), "_" + word()]) for _ in range(rng.randint(1, 8)))

    def long_word() -> str:
        x = word(5, 11)
        while len(x) < 16:
            x += word(2, 4)
        return rng.choice([x, x, x.title(), x.upper()]) + rng.choice(["", "", ".", "-"])

    hexes = lambda k: pick(k, digits + "abcdef")
    return {
        "hex": lambda: hexes(rng.randint(16, 23)), "alnum": lambda: rng.choice(["", "", "ghp_", "xoxb-", "sk_live_", "AIza", "eyJ"]) + pick(rng.randint(14, 48), lower + upper + digits),
        "base64": lambda: pick(rng.randint(20, 64), lower + upper + digits + "+/") + rng.choice(["", "=", "=="]), "letters": lambda: pick(rng.randint(16, 40), lower + upper), "one case": lambda: pick(rng.randint(20, 40), rng.choice([lower, upper])),
        "upper and digits": lambda: pick(rng.randint(16, 32), upper + digits), "short": lambda: pick(rng.randint(8, 14), lower + upper + digits), "leet": leet,
        "passphrase": lambda: rng.choice("---_.").join(word(1, 3) for _ in range(rng.randint(4, 6))),
        "number": lambda: pick(rng.randint(6, 19), digits), "date": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(["", f"T{rng.randint(10, 23)}"]), "version": lambda: f"{number(3)}.{number(3)}.{number(6)}",
        "host": lambda: f"{word()}{number(2)}.{rng.choice(['', word(2) + '.'])}{word()}.{rng.choice(['com', 'org', 'net', 'de'])}", "url": lambda: f"www.{word()}.{word()}.com/{path()}", "path": lambda: rng.choice([path(), f"/{path()}.{word(1, 1)}"]),
        "camel": lambda: rng.choice([word(1, 2), word(1, 2).title()]) + "".join(word(1, 2).title() for _ in range(rng.randint(1, 4))) + rng.choice(["", "", number(2)]), "long word": long_word, "capitals": lambda: word(3, 5).upper(),
        "snake": lambda: "_".join(word(1, 2) for _ in range(rng.randint(2, 6))) + rng.choice(["", "_" + number(3)]), "hyphens": lambda: "-".join(word(1, 2) for _ in range(rng.randint(4, 6))), "word and number": lambda: rng.choice([word(2) + number(4), f"{word(2)}-{number(4)}"]),
        "uuid": lambda: rng.choice([str.lower, str.lower, str.lower, str.upper])("-".join(hexes(k) for k in (8, 4, 4, 4, 12))), "data image": lambda: "iVBORw0KGgo" + pick(rng.randint(30, 90), lower + upper + digits + "+/"),
        "name": lambda: word(2).title() + rng.choice([".", "", "=", "-" + word(2).title()]),
    }


def synthetic(n: int = SYNTHETIC, seed: int = 5) -> dict[str, list[str]]:
    """n windows of each family of SECRET and CLEAN (of UUIDs and passphrases twice as many), in surroundings that fit: those of TOLD only
    behind key words, images behind what names them."""
    rng, value_of = random.Random(seed + 1), made_up(seed)
    prose = lambda: " ".join(value_of["name"]().rstrip(".=").lower() for _ in range(rng.randint(0, 6)))
    behind = ["", " ", "\n", "@", "'", '"', ", ", ". ", "&", ")"]
    out: dict[str, list[str]] = {f: [] for f in (*SECRET, *CLEAN)}
    for family, made in out.items():
        clean = family in CLEAN
        while len(made) < (2 * n if family in ("uuid", "passphrase") else n):
            own, lead, tail = value_of[family](), "", ""
            if not clean and family not in TOLD and rng.random() < 0.2:  # inside of a longer run
                lead, tail = value_of["path"]() + rng.choice("/=_."), rng.choice(["", "/" + value_of["path"]()])
            head = rng.choice(USUAL if clean else NAMED if family in TOLD else [*NAMED, *[""] * 8, *USUAL])
            if family == "data image":
                head = "data:image/png;base64,"
            front = f"{prose()}{rng.choice([' ', chr(10), ''])}{head}"
            if family not in (*TOLD, "data image") and rng.random() < 0.3:  # what the texts before and behind are must not matter either
                front = "" if rng.random() < 0.5 else front[-rng.randint(0, 8) :]
            value = lead + own + tail
            whole = stretch(f"{front}{value}{rng.choice(behind)}{prose()}", len(front), len(front) + len(value))
            at = places(len(whole))
            if not clean:
                at = [i for i in at if i <= len(lead) and len(lead) + len(own) <= i + OWN] or [i for i in at if len(lead) <= i < len(lead) + len(own) - 8]
            if family in (*TOLD, "data image"):
                at = at[:1]
            if at:
                i = rng.choice(at)
                made.append(whole[i : i + WIDTH])
    return out


def held_out(w: str) -> bool:
    """Whether a window is for calibration and threshold, never for fitting."""
    return zlib.crc32(w.encode("utf-8", "replace")) % 5 == 0


def train(positive: list[str], negative: list[str], *, recall: float = 0.98, epochs: int = 14, seed: int = 11) -> Network:
    """A network from labelled windows. A fifth of them (by crc32) sets calibration and threshold."""
    net = Network.new(seed)
    if len(positive) < 10 or len(negative) < 10:
        return net  # nothing to learn from: adds nothing
    rng = np.random.default_rng(seed)
    every = [(w, 1, held_out(w)) for w in positive] + [(w, 0, held_out(w)) for w in negative]
    x, y, out = codes([w for w, _, _ in every]), np.array([k for _, k, _ in every], np.float32), np.array([h for _, _, h in every])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())).astype(np.float32)
    fitted = np.nonzero(~out)[0]
    params = [net.embed, net.conv, net.conv_bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.004 if epoch < 0.7 * epochs else 0.0012
        rng.shuffle(fitted)
        for lo in range(0, len(fitted), 64):
            at, t = fitted[lo : lo + 64], t + 1
            for k, g in enumerate(net.gradients(x[at], y[at], weight[at])):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    z, yy = net.logits(x[out]), y[out]
    if not yy.any() or yy.all():
        return net
    w = np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):  # Platt's calibration, with a weak prior at (1, 0)
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (yy - p) - 0.1 * (w - [1.0, 0.0]))
        w = w + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
    net.slope, net.shift = float(max(w[0], 1e-3)), float(w[1])
    p = net.probability(x[out])
    own = np.sort(p[yy == 1])
    net.threshold = float(own[int((1 - recall) * len(own))])
    net.precision = float(yy[p >= net.threshold].mean())
    return net


def log_odds_bin(p: np.ndarray) -> np.ndarray:
    p = np.clip(p.astype(float), 1e-15, 1 - 1e-15)
    return np.clip(np.floor((np.log(p / (1 - p)) + 35) * (BINS / 70)), 0, BINS - 1).astype(np.int64)


def threshold(rows: DataFrame, net: Network, apart: dict[str, list[str]], recall: float) -> float:
    """The highest threshold that keeps `recall` of all held-out pattern spans of the table, as they stand, and
    FAMILY_RECALL of each family of secrets in `apart`; for the table the lower edge of a bin."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, np.int64)
        for batch in batches:
            own = [w for ws in batch.column("positive").to_pylist() for w in ws if held_out(w)]
            for lo in range(0, len(own), SCORED):
                n += np.bincount(log_odds_bin(shared.value.probability(codes(own[lo : lo + SCORED]))), minlength=BINS)
        at = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(at), pa.array(n[at])], ["bin", "n"])

    n = np.zeros(BINS, np.int64)
    for r in rows.select("positive").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        n[r.bin] = r.n
    limits = [float(np.sort(net.probability(codes(apart[f])))[int((1 - FAMILY_RECALL) * len(apart[f]))]) for f in SECRET if apart.get(f)]
    if n.any():
        kept = np.cumsum(n[::-1])[::-1]
        limits.append(float(1 / (1 + np.exp(-(int(np.nonzero(kept >= recall * n.sum())[0].max()) * 70 / BINS - 35)))))
    return min(limits, default=2.0)


def measured(net: Network, apart: dict[str, list[str]]) -> dict[str, float]:
    """The share of each family over the threshold: recall of secrets, false alarms of the clean ones."""
    return {f: float((net.probability(codes(ws)) >= net.threshold).mean()) for f, ws in apart.items() if ws}


def sampled(windows: DataFrame, col: str, most: int) -> list[str]:
    """At most `most` different windows, by the order of their hashes."""
    one = windows.select(F.explode(col).alias("w")).distinct()
    return [r.w for r in one.orderBy(F.xxhash64("w"), "w").limit(most).collect()]


def secrets(docs: DataFrame, *, sample: int = 4000, recall: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT's columns for every row of `docs`.

    sample: the most pattern spans that the network is fitted on (of about 100 bytes each), beside made-up
    findings; all held-out ones and made-up findings of each family set the threshold (threshold()), and
    all candidates are scored, over their whole length. The threshold keeps its recall whatever that costs
    in precision; the shares of clean families over it are logged. Null or empty text: no spans (base_sha256 of the empty string). Null id: passed on. Repeated rows: each scanned. Spans that
    start together: in the order of KINDS. A score equal to the threshold counts. Very long texts:
    whole, in time that grows with their length. Empty table: no rows. Other columns, whatever their
    names, are not read.
    """
    small_batches(docs.sparkSession)
    rows = durable(found(docs, id_col, text_col), "secrets")
    fit, apart = synthetic(), synthetic(APART, seed=77)
    of = lambda families: [w for f in families for w in fit[f]]
    net = train(sampled(rows, "positive", sample) + of(SECRET), of(CLEAN), recall=recall)
    net.threshold = threshold(rows, net, apart, recall)
    logging.getLogger(__name__).info("secrets: threshold %.4f; over it, by family: %s", net.threshold, measured(net, apart))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            p = iter(shared.value.scores([x for r in rows for x in r["stretches"]]))
            spans = []
            for r in rows:
                more = [(s, 3, e) for s, e in zip(r["starts"], r["ends"], strict=True) if next(p) >= shared.value.threshold]
                base = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r["base"].split(",") if x)]
                spans.append(written(sorted(base + more)))
            sha = [hashlib.sha256(r["base"].encode()).hexdigest() for r in rows]
            n = [pa.array([r[k] for r in rows], pa.int64()) for k in ("doc_id", "n_assign", "n_access", "n_hex")]
            yield pa.record_batch([*n, pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base", "starts", "ends", "stretches").mapInArrow(run, RESULT)
