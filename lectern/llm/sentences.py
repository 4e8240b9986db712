"""Sentences by a linear-chain model over characters.

A document is parted into blocks (blank lines, headings, table lines, list items, fences). Within a
block every character is tagged as inside or as the end of a sentence. Characters that can't end one
(neither a closing mark nor, in scripts without such marks, a blank; and any mark before a word that
begins in lower case) are inside for certain, so the chain is carried over the open characters alone. A
log-linear chain gives each open character a score from features of its surroundings, and each pair of
neighbouring tags one by the words between them; Viterbi decoding takes the best sequence of tags of
the block.

The weights are an averaged structured perceptron's, trained in two stages on a bounded sample of
documents (``sample_rows``, ``sample_chars``) that labelling rules (``label``) have tagged. The word
lists of the rules are no features. The first stage sees no word at all, only shapes: length, case and
dots of the token before a mark, the class of what follows, brackets and quotes, the words since the last
open character. What it learns holds for abbreviations that the sample lacks. The second stage keeps
these weights and adds what the sample says of single tokens: the token, the words around it, how often
it stands with a full stop, and how often a lower-case word follows that.

For scripts without marks the sample also gives text whose blanks are all that is left: its punctuation
is stripped, and known units (cells, items, lines) are put together. Sentences of the sample are also put
together at random, with and without blanks, so that languages meet that no document of it mixes.

Cases: null, empty and blank texts have no sentence; a run without any boundary is one; a text of any
length is processed whole, in time linear in its length; repeated rows give repeated sentences.
"""

from __future__ import annotations

import json
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks, brackets and abbreviations.
FULL = "。！？｡．"
OTHER_FULL = "।॥؟۔።፧۞"
MARKS = ".!?…‥" + FULL + OTHER_FULL + ";;"
PAIRS = dict(zip("(（[【「『«‹“〈《｢", ")）]】」』»›”〉》｣", strict=True))
CLOSERS = set(PAIRS.values()) | {'"', "“", "’", "'"}
OPENERS = set(PAIRS) | {'"', "„", "¿", "¡", "‚"}
#: Abbreviations that words of a sentence follow.
NEVER_LAST = set(
    "mr mrs ms dr prof st sr sra srta ing lic m mm mme mlle hr fr frl app fig figs sec sect no nos nr abb abs kap bd art ch chap vol cap pág págs apdo núm cf vs approx ca e.g i.e eg ie p pp s z b u d h vgl bzw c.-à-d c.-à.-d ex ej ed eds "
    "стр рис табл см гл им т г ул тыс млн н напр ср п πχ π.χ βλ σελ εικ κεφ αρ p.ex p.ej gen col sgt capt lt rev hon jan feb mar apr jun jul aug sep sept oct nov dec tel tab al".split()
)
#: Of these, the ones that are words too: abbreviations only before a number.
ALSO_WORDS = set("no nos art sec tab gen mar sun al".split())
#: Abbreviations that a sentence may end with.
MAY_END = set("etc usw p.m a.m pm am inc co ltd corp ff et.s др д т.д т.п jr sr.jr u.s a.d b.c κ.λπ κλπ al s.a gmbh cie uhr".split())
TIMES = {"p.m", "a.m", "pm", "am"}
TITLES = {"mr", "mrs", "ms", "dr", "prof", "m", "mme", "sra", "ing"}
ORDINAL_BEFORE = set("im am der die das den dem des zum zur vom beim ab bis seit jeden jede jedes".split())
SAID = "问说道答写称想讲"

#: By how much the right tag leads in training.
MARGIN = 3.0
BLANK_SCRIPT = "฀-๿຀-໿က-႟ក-៿"
CANDIDATE = re.compile(rf"[{re.escape(MARKS)}]+|(?<=[{BLANK_SCRIPT}])\s+(?=\S)")
BLANK_LETTER = re.compile(rf"[{BLANK_SCRIPT}]")
HEADING, TABLE, FENCE = re.compile(r"\s{0,3}#{1,6}(?:\s|$)"), re.compile(r"\s*\|"), re.compile(r"\s*(```|~~~)")
ITEM = re.compile(r"\s*(?:(-)|(\d+)\.)[ \t]+(?=\S)")
LINE = re.compile(r"[^\n]*\n?")
#: What a token begins after.
BEFORE_TOKEN = re.compile(r"[\s(（\[«“„\"'‘’「『]")
STOP = re.compile(rf"[{re.escape(MARKS)}\n]")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
#: Longer tokens are known by their shape alone.
LONGEST = 40
QUOTES = re.compile(r"[()（）\[\]【】「」『』«»‹›“”„\"〈〉《》｢｣]")
WORD = re.compile(r"[^\W_]+(?:[-’'][^\W_]+)*")


def blocks(text: str) -> list[tuple[int, int, bool, int]]:
    """(start, end, fixed, marker end) of each block; a fixed block is one sentence."""
    out: list[tuple[int, int, bool, int]] = []
    start = end = marker = -1
    last_no, fence_at, fence = -1, -1, ""
    listed = plain = False

    def close() -> None:
        nonlocal start
        if start >= 0:
            out.append((start, end, False, marker))
        start = -1

    at = 0
    for m in LINE.finditer(text):
        line = m.group()
        if not line:
            break
        a, at = at, at + len(line)
        if fence:
            if line.strip().startswith(fence):
                out.append((fence_at, at, True, fence_at))
                fence = ""
            continue
        if (f := FENCE.match(line)) is not None:
            close()
            fence, fence_at, plain = f.group(1), a, False
            continue
        if not line.strip():
            close()
            plain = False
            continue
        if HEADING.match(line) or TABLE.match(line):
            close()
            out.append((a, at, True, a))
            plain = listed = False
            continue
        item = ITEM.match(line)
        if item is not None and item.group(2) is not None:
            # a wrapped line may begin with a number and a full stop
            number = int(item.group(2))
            if not (number == last_no + 1 if listed and last_no >= 0 else not plain or number == 1):
                item = item if not plain else None
        if item is not None:
            close()
            start, end, marker = a, at, a + item.end()
            last_no = int(item.group(2)) if item.group(2) else -1
            listed = plain = True
            continue
        if start < 0:
            start, marker, listed = a, a, False
        end, plain = at, True
    if fence:
        out.append((fence_at, len(text), True, fence_at))
    close()
    out.sort()
    return out


def spans(s: str) -> list[tuple[int, int]]:
    """Matched quotes and brackets of a block, by their start; each is looked at once."""
    if QUOTES.search(s) is None:
        return []
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    for m in QUOTES.finditer(s):
        ch, i = m.group(), m.start()
        if ch in PAIRS and ch != "“" or ch == "„" or ch in '"“' and not open_[ch]:
            want = "“" if ch == "„" else PAIRS.get(ch, '"')
            stack.append((want, i))
            open_[want] += 1
        elif open_[ch]:
            while True:
                c, j = stack.pop()
                open_[c] -= 1
                if c == ch:
                    found.append((j, i))
                    break
    return sorted(found)


@lru_cache(maxsize=200_000)
def kind(ch: str) -> str:
    """The class of a character."""
    if not ch:
        return "end"
    if ch.isspace():
        return "blank"
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        if ch.isupper() or ch.istitle():
            return "upper"
        if ch.islower():
            return "lower"
        o = ord(ch)
        if 0x3040 <= o < 0x30A0:
            return "hiragana"
        if o >= 0x2E80 and not 0xAC00 <= o < 0xD7B0:
            return "cjk"
        return "hangul" if 0xAC00 <= o < 0xD7B0 else "thai" if BLANK_LETTER.match(ch) else "caseless"
    if ch in OPENERS:
        return "open"
    if ch in CLOSERS:
        return "close"
    return "dash" if ch in "-–—" else "comma" if ch in ",，、:：;" else "mark" if ch in MARKS else "other"


class Place:
    """What is around one open character of a block."""

    __slots__ = ("end", "mark", "run", "token", "shape", "form", "last", "before", "next", "blank", "word", "letters", "camel", "inside", "closes", "intro", "said", "words", "greek", "prior", "alone_bracket")

    def look(self) -> tuple:
        """All but the words themselves."""
        return (self.mark, self.run, self.shape, self.form, self.last, self.before, self.next, self.blank, self.letters, self.camel, self.inside, self.closes, self.intro, self.said, self.greek, self.alone_bracket)

    def key(self) -> tuple:
        return (*self.look(), self.token, self.word, self.prior, self.words)


@lru_cache(maxsize=50_000)
def form_of(token: str, size: int) -> str:
    """The form of a token: its length, case, dots, and whether it has digits or vowels."""
    case = "U" if token.isupper() else "T" if token[:1].isupper() else "l" if token[:1].islower() else "-"
    more = "." if "." in token else ""
    if any(c.isdigit() for c in token):
        more += "0"
    return f"{min(size, 8)}{case}{more}"


def places(s: str) -> list[Place]:
    """The open characters of a block, in order, in one pass."""
    found: list[Place] = []
    held = spans(s)
    starts = {b: a for a, b in held}
    outer: list[tuple[int, int]] = []  # spans in no other
    for x in held:
        if not outer or x[0] > outer[-1][1]:
            outer.append(x)
    around = 0
    breaks = [m.start() for m in BEFORE_TOKEN.finditer(s)] if "." in s or "…" in s or "‥" in s else []
    n = len(s)
    last_end = since = 0
    for m in CANDIDATE.finditer(s):
        i, j = m.span()
        if i < last_end:
            continue
        run = m.group()
        p = Place()
        blank_mark = run.isspace()
        mark = "blank" if blank_mark else run[-1]
        if not blank_mark and ("…" in run or "‥" in run or ".." in run):
            mark = "…"
        elif mark in FULL:
            mark = "。"
        elif mark in OTHER_FULL:
            mark = "।"
        elif mark in "!?":
            mark = "?"
        elif mark in ";;":
            mark = ";"
        e = i if blank_mark else j
        closed = -1
        if not blank_mark:
            while True:  # closers, also after the blank of French quotes
                k = e
                while k < n and s[k] in "   \n" and k - e < 2:
                    k += 1
                if k < n and s[k] in CLOSERS and (k == e or s[k] in "»›"):
                    begin = starts.get(k)
                    if begin is not None and begin < i:
                        closed, e = begin, k + 1
                        continue
                    if begin is None and k == e and s[k] not in "\"“'’":
                        e = k + 1
                        continue
                break
            while e < n and s[e] in MARKS and s[e] != ";" and closed >= 0:
                e += 1
        k = e
        while k < n and s[k].isspace():
            k += 1
        p.end, p.mark, p.run = e, mark, min(len(run), 3)
        p.blank = k > e
        nxt = s[k] if k < n else ""
        p.next = kind(nxt)
        last_end = e
        if not blank_mark and p.next in ("lower", "digit", "other", "mark", "dash") and not p.blank and mark != "।" and mark != "。" and closed < 0:
            continue
        following = WORD.match(s, k)
        word = following.group() if following else ""
        p.camel = p.next == "lower" and not word.islower()
        if p.next == "lower" and not p.camel:
            continue  # no sentence begins in lower case
        p.word, p.letters = word.lower() if len(word) <= LONGEST else "", min(len(word), 3)
        before = s[i - 1] if i else ""
        p.before = kind(before)
        token, size, p.prior = "", 0, ""
        if mark in (".", "…"):
            at = bisect_left(breaks, i)
            begin = breaks[at - 1] + 1 if at else 0
            dot = s.rfind(".", begin, i)
            if dot >= 0 and dot + 1 < i and s[dot + 1].isupper():
                head = s.rfind(".", begin, dot)
                if dot - max(head, begin - 1) > 4 - (head < 0):  # no blank after the sentence before
                    begin = dot + 1
            size = i - begin
            if size <= LONGEST:
                token = s[begin:i]
            if token.isdigit():
                b = begin
                while b and s[b - 1].isspace():
                    b -= 1
                a = b
                while a and not s[a - 1].isspace() and s[a - 1] != ".":
                    a -= 1
                p.prior = s[a:b].lower() if b - a <= LONGEST else ""
        p.shape = "long" if size > LONGEST else "none" if not token else "digits" if token.isdigit() else "initial" if len(token) == 1 and token.isupper() else "letter" if len(token) == 1 else "dotted" if "." in token else "short" if len(token) <= 3 else "long"
        p.form = p.last = form_of(token, size) if mark in (".", "…") else ""
        if "." in token:
            last = token.rpartition(".")[2]
            p.last = form_of(last, len(last))
        p.token = token.lower()
        while around < len(outer) and outer[around][1] < i:
            around += 1
        p.inside = around < len(outer) and outer[around][0] < i and outer[around][1] >= e
        p.closes = closed >= 0
        p.alone_bracket = closed >= 0 and s[closed] in "(（[【"
        p.intro, p.said = "none", False
        if closed >= 0:
            b = closed - 1
            while b >= 0 and s[b].isspace():
                b -= 1
            c = s[b] if b >= 0 else ""
            p.intro = "start" if not c or c in MARKS or c in CLOSERS else "colon" if c in ":：" else "comma" if c in ",，" else "word"
            stop = STOP.search(s, k)  # a clause that ends with a verb of saying
            p.said = stop is not None and stop.start() > k and s[stop.start() - 1] in SAID
        p.words = min(len(s[since:i].split(None, 6)), 6)
        p.greek = mark == ";" and 2 * len(GREEK.findall(s, since, i)) > sum(map(str.isalpha, s[since:i]))
        found.append(p)
        since = e
    return found


def label(p: Place) -> bool:
    """The labelling rules: whether a sentence ends here. They tag the training sample."""
    if p.next == "end":
        return True
    if p.inside:
        return False
    if p.mark == ";":
        return p.greek and (p.blank or p.next == "upper")
    if p.mark == "blank":
        return p.next in ("thai", "upper")
    if p.closes:
        if p.next in ("lower", "comma", "dash", "hiragana", "close") and not p.camel and not (p.alone_bracket and p.next == "hiragana"):
            return False
        if p.alone_bracket:
            return p.intro == "start" or p.blank and p.intro != "word"
        if p.intro == "start":
            return not (p.said or p.next == "hangul" and not p.blank)
        if p.next == "hangul" and not p.blank:
            return False
        return p.intro in ("colon", "comma") or p.mark == "。" or p.blank and p.next in ("upper", "open", "digit", "cjk")
    if p.mark in "。।":
        return p.next not in ("comma", "close")
    if p.mark == "…":
        return p.blank and p.next in ("upper", "open", "cjk", "thai", "hangul", "caseless")
    if p.next in ("comma", "close", "dash"):
        return False
    if p.mark == "?":
        return p.next != "lower" or p.camel
    token = p.token
    if not p.blank:
        return p.next in ("upper", "open", "cjk", "thai", "hangul", "caseless", "hiragana") and p.shape not in ("initial", "letter", "dotted") and token not in NEVER_LAST and len(p.word) != 1
    if p.next == "lower" and not p.camel:
        return False
    if p.shape == "digits":
        return not (p.prior in ORDINAL_BEFORE and len(token) <= 2)
    if token in ALSO_WORDS:
        return p.next != "digit"
    if token in MAY_END:
        return p.next != "digit" and not (token in TIMES and p.words <= 4 and p.word in TITLES)
    if token in NEVER_LAST or p.shape in ("initial", "letter"):
        return False
    return True


def shapes(p: Place) -> list[str]:
    """Names of the features that hold at an open character, without any word."""
    m, n, b = p.mark, p.next, int(p.blank)
    place = f"{int(p.inside)}{int(p.closes)}{int(p.alone_bracket)}{p.intro}"
    open_ = f"{int(p.inside)}{int(p.closes)}"
    return [
        f"m{m}|{n}|{b}",
        f"i{int(p.inside)}|{n == 'end'}",
        f"q{place}|{n}",
        f"Q{place}|{m}|{n}|{b}|{int(p.said)}|{int(p.camel)}",
        f"s{m}|{p.shape}|{n}|{b}|{open_}|{int(p.camel)}",
        f"f{p.form}|{n}|{b}|{open_}",
        f"F{p.form[:1]}|{n}|{b}",
        f"C{p.form[1:]}|{n}|{b}",
        f"L{p.last}|{n}|{b}",
        f"c{int(p.camel)}|{n}|{p.shape}|{open_}",
        f"b{m}|{p.before}|{n}|{b}",
        f"g{m}|{int(p.greek)}|{n}|{b}",
        f"l{m}|{p.letters}|{n}|{b}|{p.shape}",
        f"r{m}|{p.run}|{n}|{b}",
    ]


def words(p: Place, habits: dict[str, str]) -> list[str]:
    """Names of the features of the words at an open character; ``habits`` says how the sample uses a token."""
    n, b = p.next, int(p.blank)
    out = [f"w{p.word}|{p.shape}"] if p.word else []
    if p.token:
        open_ = f"{int(p.inside)}{int(p.closes)}"
        out += [f"t{p.token}|{open_}", f"n{p.token}|{n}|{b}|{open_}", f"v{p.token}|{p.word}", f"h{habits.get(p.token, '-')}|{n}|{b}|{open_}"]
        if p.words <= 4:
            out.append(f"o{p.token}|{p.word}|{p.words}")
    if p.prior:
        out += [f"p{p.prior}|{p.form}|{n}", f"P{p.prior}|{p.word}"]
    return out


def habits_of(texts: list[str]) -> dict[str, str]:
    """How tokens are used in texts: the share of their uses that have a full stop, and the share of these
    that a lower-case word, a number or a comma follows, both in four steps."""
    free: Counter[str] = Counter()
    dotted: Counter[str] = Counter()
    within: Counter[str] = Counter()
    for t in texts:
        for m in re.finditer(r"([^\W\d_]+(?:\.[^\W\d_]+)*)(\.?)(?=(\s*)(\S?))", t):
            token = m[1].lower()
            if not m[2]:
                free[token] += 1
            else:
                dotted[token] += 1
                within[token] += m[4].islower() or m[4].isdigit() or m[4] == ","
    step = lambda a, n: 0 if not a else 3 if a == n else 1 if 2 * a < n else 2
    return {t: f"{step(n, n + free[t])}{step(within[t], n)}" for t, n in dotted.items()}


#: Tags and the words between them: [before][now].
Moves = list[list[list[float]]]


def still() -> Moves:
    return [[[0.0, 0.0], [0.0, 0.0]] for _ in range(7)]


def viterbi(scores: list[float], gaps: list[int], moves: Moves) -> list[bool]:
    """The best sequence of tags; before the first open character a sentence has ended. gaps: the words
    before each open character since the last."""
    inside, ends = float("-inf"), 0.0
    back: list[tuple[int, int]] = []
    for x, g in zip(scores, gaps, strict=True):
        (ii, ie), (ei, ee) = moves[g]
        a, b = inside + ii, ends + ei
        c, d = inside + ie + x, ends + ee + x
        back.append((int(b > a), int(d > c)))
        inside, ends = max(a, b), max(c, d)
    tag = int(ends > inside)
    out = []
    for b in reversed(back):
        out.append(bool(tag))
        tag = b[tag]
    return out[::-1]


class Model:
    """Weights by feature for 'a sentence ends here', of neighbouring tags, and the habits of tokens."""

    def __init__(self, weights: dict[str, float], moves: Moves, habits: dict[str, str]) -> None:
        self.weights, self.moves, self.habits = weights, moves, habits
        self.known: dict[tuple, float] = {}

    def score(self, p: Place) -> float:
        key = p.key()
        found = self.known.get(key)
        if found is None:
            get = self.weights.get
            found = sum(get(f, 0.0) for f in shapes(p)) + sum(get(f, 0.0) for f in words(p, self.habits))
            if len(self.known) < 200_000:
                self.known[key] = found
        return found

    def tags(self, found: list[Place]) -> list[bool]:
        return viterbi([self.score(p) for p in found], [p.words for p in found], self.moves)

    def to_json(self) -> str:
        return json.dumps([self.weights, self.moves, self.habits], sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Model:
        return cls(*json.loads(text))


def stripped(texts: list[str], rng: random.Random) -> list[list[tuple[Place, bool]]]:
    """Training text for scripts without marks: known units without punctuation, put together with
    blanks; where units meet, a sentence ends."""
    units = []
    for t in texts:
        for start, end, fixed, marker in blocks(t):
            body = t[marker if not fixed else start : end].strip()
            cells = [c.strip() for c in body.strip("|").split("|")] if fixed and body.startswith("|") else [] if fixed else [body]
            for c in cells:
                c = re.sub(rf"[{re.escape(MARKS)}]+(?=\s|$)", "", " ".join(c.split()))
                if BLANK_LETTER.match(c) and not re.search(rf"[{BLANK_SCRIPT}] [{BLANK_SCRIPT}]", c):
                    units.append(c)
    out = []
    rng.shuffle(units)
    for k in range(0, len(units) - 1, 4):
        group = units[k : k + 4]
        ends, at = set(), 0
        for u in group:
            at += len(u)
            ends.add(at)
            at += 1
        line = " ".join(group)
        out.append([(p, p.end in ends or p.next == "end") for p in places(line) if p.mark == "blank"])
    return [x for x in out if x]


def mixed(texts: list[str], rng: random.Random) -> list[list[tuple[Place, bool]]]:
    """Training text of sentences of any language side by side, half of it without blanks between them."""
    pool = []
    for t in texts:
        for start, end, fixed, marker in blocks(t):
            if not fixed:
                body, a = t[marker:end], 0
                for p in places(body):
                    if label(p):
                        pool.append(body[a : p.end].strip())
                        a = p.end
    pool = sorted(set(pool))
    out = []
    for k in range(len(texts) // 3 if pool else 0):
        line = ("" if k % 2 else " ").join(rng.choice(pool) for _ in range(4))
        if found := places(line):
            out.append([(p, label(p)) for p in found])
    return out


def learn(chains: list[tuple[list[list[str]], list[int], list[float], list[bool]]], moves: Moves, epochs: int, rng: random.Random) -> tuple[dict[str, float], Moves]:
    """An averaged structured perceptron over chains (features, gaps, scores that are given, tags). What is
    right has to lead by a margin, so that averaging keeps it right."""
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    moves = [[list(r) for r in m] for m in moves]
    moved = still()
    step = 1
    for _ in range(epochs):
        rng.shuffle(chains)
        wrong = 0
        for feats, gaps, given, gold in chains:
            step += 1
            got = viterbi([x + sum(weights.get(f, 0.0) for f in fs) + (-MARGIN if y else MARGIN) for fs, x, y in zip(feats, given, gold, strict=True)], gaps, moves)
            if got == gold:
                continue
            wrong += 1
            a = b = True
            for fs, gap, g, y in zip(feats, gaps, gold, got, strict=True):
                if g != y:
                    d = 1.0 if g else -1.0
                    for f in fs:
                        weights[f] += d
                        total[f] += d * step
                if (a, g) != (b, y):
                    moves[gap][a][g] += 1
                    moved[gap][a][g] += step
                    moves[gap][b][y] -= 1
                    moved[gap][b][y] -= step
                a, b = g, y
        if not wrong:
            break
    return {f: w - total[f] / step for f, w in weights.items()}, [[[moves[k][a][b] - moved[k][a][b] / step for b in (0, 1)] for a in (0, 1)] for k in range(7)]


def train(texts: list[str], epochs: int = 15, seed: int = 7) -> Model:
    """The model of a tagged sample; the same sample gives the same model."""
    rng = random.Random(seed)
    chains = []
    for t in texts:
        for start, end, fixed, marker in blocks(t):
            if not fixed and (found := places(t[marker:end])):
                chains.append([(p, label(p)) for p in found])
    chains += stripped(texts, rng)
    chains += mixed(texts, rng)
    habits = habits_of(texts)
    first = {p.look(): p for c in chains for p, _ in c}
    shape = {k: shapes(p) for k, p in first.items()}
    # chains that look alike teach the same; each is kept once for each stage
    looks = dict.fromkeys((tuple((p.look(), p.words) for p, _ in c), tuple(y for _, y in c)) for c in chains)
    data = [([shape[k] for k, _ in keys], [g for _, g in keys], [0.0] * len(keys), list(gold)) for keys, gold in looks]
    weights, moves = learn(data, still(), epochs // 2, rng)
    given = {k: sum(weights.get(f, 0.0) for f in fs) for k, fs in shape.items()}
    every = {p.key(): p for c in chains for p, _ in c}
    word = {k: words(p, habits) for k, p in every.items()}
    base = {k: given[p.look()] for k, p in every.items()}
    seen = dict.fromkeys((tuple(p.key() for p, _ in c), tuple(y for _, y in c)) for c in chains)
    data = [([word[k] for k in keys], [k[-1] for k in keys], [base[k] for k in keys], list(gold)) for keys, gold in seen]
    more, moves = learn(data, moves, epochs, rng)
    return Model(weights | more, moves, habits)


def sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points, end exclusive."""
    out = []
    for start, end, fixed, marker in blocks(text):
        cuts = []
        if not fixed:
            found = places(text[marker:end])
            if found:
                cuts = [marker + p.end for p, y in zip(found, model.tags(found), strict=True) if y]
        a = start
        for b in [*cuts, end]:
            piece = text[a:b]
            left = len(piece) - len(piece.lstrip())
            if left < len(piece):
                out.append((a + left, a + len(piece.rstrip())))
            a = b
    return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 2500, sample_chars: int = 4_000_000) -> Model:
    """The model of a bounded sample: the ``sample_rows`` documents that come first by the hash of their
    key and text, as far as they hold ``sample_chars`` characters together; a document over the bound is
    left out of the sample whole. Only sizes are sorted; texts come to the driver after the bound is known."""
    rows = df.where(F.length(F.trim(text)) > 0).select(F.xxhash64(key, text).alias("h"), F.length(text).alias("size"))
    left, picked = sample_chars, []
    for h, size in rows.orderBy("h", "size").limit(sample_rows).collect():
        if size <= left:
            left -= size
            picked.append(h)
    if not picked:
        return Model({}, still(), {})
    hashes = df.sparkSession.createDataFrame([(h,) for h in sorted(set(picked))], "h bigint")  # at most sample_rows
    texts = df.select(text, F.xxhash64(key, text).alias("h")).where(F.length(text) <= sample_chars).join(F.broadcast(hashes), "h", "left_semi").select(text).distinct()
    return train(sorted(r[0] for r in texts.collect()))


def split_sentences(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos), one row per sentence; a narrow map over the scan, without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.moves, model.habits))
    of = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            keys, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    for a, b in sentences(t, own):
                        keys.append(i)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_pos", "end_pos"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {of}, start_pos int, end_pos int")
