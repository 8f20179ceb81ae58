"""Personal data: exact base rules, and a semi-Markov conditional random field that adds spans.

The base rules find e-mail and IP addresses, card and phone numbers by pattern
and check.  The semi-Markov model reads stretches of words around digits and
``@`` signs: candidate segments of one to ``SEGMENT_WORDS`` words are scored by
features of the whole span (its check digits, separators, parts, neighbours),
and dynamic programming over segments chooses boundaries and types jointly.
Its weights are fitted here, on generated sentences, by maximum likelihood.
Spans of the model that touch a base span are dropped; base spans always stay.

Work and memory are linear in a text's length: patterns are matched without
backtracking over long runs, and segments have a bounded number of words.

Defined results: a null text is empty; offsets are code points, ends exclusive;
whole texts are read, however long; of model segments with equal scores the
dynamic program keeps the one it met first; ``n_*`` count base spans; repeated
rows and ids each get their row; an empty table gives no rows; only the id and
text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, text_or_empty, with_text_batches

KINDS = ("email", "ip", "card", "phone")
SEGMENT_WORDS = 6
#: Words of context on either side of a trigger, and of training sentences.
CONTEXT = 2
TRAINING_SENTENCES = 600
#: Least margin, in log odds, of a segment over leaving its words outside any span.
MARGIN = 1.0

# The patterns of the base rules. A number starts at its first digit, so a long run of digits is tried once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from each ``@`` outwards: what stands before it decides where a match starts."""
    found: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
        # A local part never reaches back over an @, so what stands before this one is done with.
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return found


def _ips(text: str) -> list[Span]:
    return [
        m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))
    ]


def _cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = _NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the base rules by kind, in order."""
    return {"email": _emails(text) if "@" in text else [], "ip": _ips(text), "card": _cards(text), "phone": _phones(text)}


# The semi-Markov conditional random field.

# Words that announce a kind of personal data.
CUES = {
    "email": frozenset("email mail e-mail correo courriel contact write an".split()),
    "ip": frozenset("ip host server address adresse addr ping".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono whatsapp".split()),
}
_WORD = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>.,;:!?"
_AT_WORD = re.compile(r"(?i)(?:^|\s)[\[({]?at[\])}]?(?:\s|$)")
_SPELLED = re.compile(r"(?i)[^\s@]+\s+[\[({]?at[\])}]?\s+[^\s@]+\s+[\[({]?dot[\])}]?\s+[a-z]{2,}")
_IPV6 = re.compile(r"(?i)[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){3,7}")
_GROUPS = re.compile(r"\d+")
_NAMES = (
    "bias",
    "one word",
    "many words",
    "no digit",
    "digits 1-6",
    "digits 7-12",
    "digits 13-19",
    "digits 20+",
    "has @",
    "whole e-mail",
    "spelled e-mail",
    "four byte parts",
    "colon hex parts",
    "luhn",
    "card groups",
    "phone groups",
    "area in brackets",
    "plus first",
    "phone characters only",
    "letters and digits",
    "letter words",
    "date or time",
    "cue email",
    "cue ip",
    "cue card",
    "cue phone",
    "unit or money",
    "word in the middle is plain",
)
_DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}:\d{2}(?::\d{2})?")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PLAIN = re.compile(r"[^\W\d_]+")


def span_features(text: str, words: int, before: str) -> list[float]:
    """Features of a whole candidate span and the word before it."""
    digits = _NO_DIGIT.sub("", text)
    groups = [len(x) for x in _GROUPS.findall(text)]
    n = len(digits)
    letters = any(c.isalpha() for c in text)
    parts = text.split(".")
    cue = before.strip(_EDGE).lower()
    is_phone = n > 0 and all(c in "0123456789+().- /" for c in text)
    inner = text.split()
    return [
        1.0,
        words == 1,
        words > 2,
        n == 0,
        0 < n < 7,
        7 <= n <= 12,
        13 <= n <= 19,
        n > 19,
        "@" in text,
        bool(_MAIL.fullmatch(text)),
        bool(_SPELLED.fullmatch(text)),
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        bool(_IPV6.fullmatch(text)),
        13 <= n <= 19 and not letters and luhn(digits),
        groups in ([4, 4, 4, 4], [4, 6, 5], [16], [15]) and is_phone,
        is_phone and groups in ([3, 3, 4], [1, 3, 3, 4], [3, 4], [2, 4, 4], [5, 6], [2, 3, 3, 4], [2, 2, 2, 2, 2], [10], [11]),
        bool(re.search(r"\(\d{2,4}\)", text)),
        text.startswith("+"),
        is_phone,
        letters and n > 0 and "@" not in text,
        letters and n == 0 and "@" not in text,
        bool(_DATE.fullmatch(text)),
        *(cue in CUES[kind] for kind in KINDS),
        text[:1] in "$€£%" or text[-1:] in "$€£%",
        len(inner) > 2 and any(_PLAIN.fullmatch(x) and x.lower() not in ("at", "dot") for x in inner[1:-1]),
    ]


class Stretch:
    """Consecutive words of a text and the candidate segments over them."""

    def __init__(self, text: str, words: list[Span]):
        self.words = words
        self.segments: list[tuple[int, int, int, int]] = []  # first word, word after, start, end in the text
        rows = []
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + SEGMENT_WORDS) + 1):
                start, end = words[i][0], words[j - 1][1]
                while start < end and text[start] in _EDGE and not (text[start] == "(" and text[start + 1 : start + 2].isdigit()):
                    start += 1
                while end > start and text[end - 1] in _EDGE:
                    end -= 1
                span = text[start:end]
                if end - start < 4 or end - start > 200 or not (any(map(str.isdigit, span)) or "@" in span or _AT_WORD.search(span)):
                    continue
                before = text[words[i - 1][0] : words[i - 1][1]] if i else ""
                self.segments.append((i, j, start, end))
                rows.append(span_features(span, j - i, before))
        self.features = np.array(rows, dtype=float).reshape(-1, len(_NAMES))


_DIGIT_OR_AT = re.compile(r"[0-9@]")
_TRIGGER = re.compile(r"(?<!\S)\S*[0-9@]\S*|(?<!\S)[\[({]?at[\])}]?\s+\S+\s+[\[({]?dot[\])}]?(?!\S)", re.I)


def stretches(text: str) -> Iterator[list[Span]]:
    """Runs of words around the words with a digit or @ and around spelled-out addresses."""
    near: list[Span] = []
    for m in _TRIGGER.finditer(text):
        if near and m.start() - near[-1][1] < 120:
            near[-1] = (near[-1][0], m.end())
        else:
            near.append((m.start(), m.end()))
    for a, b in near:
        # Only the words near the triggers are cut out, whole.
        a, b = max(0, a - 60), min(len(text), b + 60)
        while a > 0 and not text[a - 1].isspace() and not text[a].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace() and not text[b - 1].isspace():
            b += 1
        words = [(a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b])]
        bare = [text[x:y].strip("[](){}").lower() if y - x <= 5 else "" for x, y in words]
        spelled = {k for i in range(len(words) - 2) if bare[i] == "at" and bare[i + 2] == "dot" for k in (i, i + 1, i + 2)}
        yield from _runs(words, [i for i, (x, y) in enumerate(words) if i in spelled or _DIGIT_OR_AT.search(text, x, y)])


def _runs(words: list[Span], hits: list[int]) -> Iterator[list[Span]]:
    begin = end = -1
    for i in hits:
        if begin >= 0 and i - CONTEXT <= end:
            end = i + CONTEXT + 1
            continue
        if begin >= 0:
            yield words[begin:end]
        begin, end = max(0, i - CONTEXT), i + CONTEXT + 1
    if begin >= 0:
        yield words[begin:end]


def best_segments(stretch: Stretch, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[str, int, int]]:
    """The segmentation of highest score: (kind, start, end) of its entities."""
    n = len(stretch.words)
    scores = stretch.features @ weights - margin
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, j, _, _) in enumerate(stretch.segments):
        ending[j].append(s)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], None  # the word alone, outside any span
        for s in ending[j]:
            k = int(scores[s].argmax())
            value = best[stretch.segments[s][0]] + scores[s, k]
            if value > best[j]:
                best[j], back[j] = value, (s, k)
    found, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            s, k = back[j]
            i, _, start, end = stretch.segments[s]
            found.append((KINDS[k], start, end))
            j = i
    return found[::-1]


def log_likelihood(stretch: Stretch, gold: dict[int, int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold segments {segment: kind} and its gradient, by forward and backward sums."""
    n, scores = len(stretch.words), stretch.features @ weights
    segments = stretch.segments
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    each = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j, _, _) in enumerate(segments):
        starting[i].append(s)
        ending[j].append(s)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[segments[s][0]] + each[s] for s in ending[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[segments[s][1]] + each[s] for s in starting[i])])
    total = forward[n]
    gradient = np.zeros_like(weights)
    value = -total
    for s, k in gold.items():
        value += scores[s, k]
        gradient[:, k] += stretch.features[s]
    if segments:
        first, after = np.array([x[0] for x in segments]), np.array([x[1] for x in segments])
        chance = np.exp(forward[first][:, None] + scores + backward[after][:, None] - total)
        gradient -= stretch.features.T @ chance
    return value, gradient


def _sentences(count: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with their entities (kind, start, end), from a fixed seed."""
    draw = np.random.default_rng(7)
    pick = lambda *options: options[int(draw.integers(len(options)))]
    number = lambda n: "".join(str(int(x)) for x in draw.integers(0, 10, n))

    def name() -> str:
        return "".join(pick(*"bcdfglmnprstv") + pick(*"aeiou") for _ in range(int(draw.integers(2, 5))))

    def card() -> str:
        stem = pick("4", "5") + number(14)
        digits = next(stem + str(d) for d in range(10) if luhn(stem + str(d)))
        groups = [digits[i : i + 4] for i in range(0, 16, 4)]
        return pick(digits, " ".join(groups), "-".join(groups), ".".join(groups))

    def entity() -> tuple[str, str]:
        kind = pick(*KINDS)
        if kind == "email":
            local, host, top = pick(name(), f"{name()}.{number(2)}"), name(), pick("com", "org", "net")
            text = pick(f"{local}@{host}.{top}", f"{name()} at {host} dot {top}", f"{name()} [at] {host} [dot] {top}", f"{name()} (at) {host} (dot) {top}")
        elif kind == "ip":
            text = pick(".".join(str(int(x)) for x in draw.integers(1, 256, 4)), ":".join(f"{int(x):x}" for x in draw.integers(16, 65536, 8)))
        elif kind == "card":
            text = card()
        else:
            a, b, c = str(int(draw.integers(201, 999))), number(3), number(4)
            text = pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{pick('33', '44', '49', '34')} {number(3)} {number(3)} {number(4)}", f"{a}.{b}.{c}", f"0{number(4)} {number(6)}")
        return kind, text

    def other() -> str:
        return pick(
            f"version {int(draw.integers(1, 9))}.{int(draw.integers(0, 9))}.",
            f"Version {int(draw.integers(1, 9))}.{int(draw.integers(0, 20))}.{int(draw.integers(0, 20))}",
            f"{int(draw.integers(1900, 2030))}",
            f"{int(draw.integers(1900, 2030))}-{int(draw.integers(10, 12))}-{int(draw.integers(10, 28))}",
            f"${number(3)},{number(3)}.{number(2)}",
            f"password={number(4)}{name()}{number(6)}",
            f'token = "{number(6)}{name()}{number(12)}"',
            f"AKIA{name().upper()}{number(6)}",
            number(int(draw.integers(1, 9))),
            number(int(draw.integers(20, 30))),
            number(16),
            f"{number(2)}:{number(2)}",
            f"{number(3)} {name()} {number(4)}",
            f"{number(1)}. {name()}",
            f"{number(2)} {number(3)} {number(1)} {number(5)} {number(2)}",
            f"page {number(3)} at {name()}",
            f"at {name()}",
            f"{name()}_{number(2)}",
        )

    for _ in range(count):
        text, gold = "", []
        for _ in range(int(draw.integers(1, 4))):
            text += " ".join(name() for _ in range(int(draw.integers(1, 4)))) + pick(" ", ", ", ". ")
            if draw.random() < 0.55:
                kind, own = entity()
                if draw.random() < 0.4:
                    text += pick(*sorted(CUES[kind])) + pick(" ", ": ")
                gold.append((kind, len(text), len(text) + len(own)))
                text += own + pick(" ", ", ", ". ")
            else:
                text += other() + " "
        yield text + name() + " " + name(), gold


def training_stretches(count: int = TRAINING_SENTENCES) -> list[tuple[Stretch, dict[int, int]]]:
    data = []
    for text, gold in _sentences(count):
        for words in stretches(text):
            stretch = Stretch(text, words)
            place = {(start, end): s for s, (_, _, start, end) in enumerate(stretch.segments)}
            inside = [g for g in gold if words[0][0] <= g[1] and g[2] <= words[-1][1]]
            if all((a, b) in place for _, a, b in inside):
                data.append((stretch, {place[a, b]: KINDS.index(kind) for kind, a, b in inside}))
    return data


@cache
def fitted_weights(rounds: int = 120, rate: float = 0.4, decay: float = 1e-4) -> np.ndarray:
    """Weights[feature, kind] by gradient ascent on the penalised likelihood (adaptive steps)."""
    data = training_stretches()
    weights, seen = np.zeros((len(_NAMES), len(KINDS))), np.full((len(_NAMES), len(KINDS)), 1e-8)
    for _ in range(rounds):
        gradient = sum(log_likelihood(stretch, gold, weights)[1] for stretch, gold in data) / len(data) - decay * weights
        seen += gradient**2
        weights = weights + rate * gradient / np.sqrt(seen)
    return weights


def model_spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    found = []
    for words in stretches(text):
        stretch = Stretch(text, words)
        if stretch.segments:
            found += best_segments(stretch, weights)
    return found


def all_spans(text: str, weights: np.ndarray) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans by kind; a model span that touches a base span is dropped."""
    base = base_spans(text)
    every = {kind: list(spans) for kind, spans in base.items()}
    added = model_spans(text, weights)
    if added:
        taken = sorted(s for spans in base.values() for s in spans)
        starts = np.array([a for a, _ in taken])
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
        for kind, start, end in added:
            n = int(np.searchsorted(starts, end))
            if n == 0 or reach[n - 1] <= start:
                every[kind].append((start, end))
    return base, {kind: sorted(set(spans)) for kind, spans in every.items()}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find_pii(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: base counts, the digest of the base spans and all spans."""
    weights = fitted_weights()

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every = all_spans(text, weights)
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return with_text_batches(documents).select(id_col, found(text_or_empty(text_col)).alias("found")).select(id_col, "found.*")


def redact(documents: DataFrame, text_col: str) -> DataFrame:
    """``documents`` with each span replaced by its kind in brackets; texts without spans stay as they are."""
    weights = fitted_weights()

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: redacted(text, weights) if isinstance(text, str) else None)

    return with_text_batches(documents).withColumn(text_col, cleaned(F.col(text_col)))


def redacted(text: str, weights: np.ndarray) -> str:
    _, every = all_spans(text, weights)
    parts, free = [], 0
    # Of spans that overlap, the one that begins first names what is cut.
    for start, end, kind in sorted((a, b, kind) for kind, spans in every.items() for a, b in spans):
        if start >= free:
            parts += [text[free:start], f"[{kind.upper()}]"]
        free = max(free, end)
    return "".join(parts) + text[free:] if parts else text


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"op4_personal_data": op4_personal_data}
ORACLES: dict = {}
