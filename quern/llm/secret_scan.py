r"""Secret scans: base patterns, and a linear-chain conditional random field for the rest.

Base spans are the whole matches, leftmost and not overlapping within a kind, of three
patterns with a least length: ``assign``, ``access``, ``hex``. They always stay.

The field tags tokens (runs of ``[\w+/.-]``, perhaps with ``=`` behind, or single other
characters) as secret begin, inside or outside, from a token's shape, the words before and
behind it and features of the whole text, with learned transition weights, decoded by
Viterbi. A token may be tagged if its shape is none of a word or number, or if a word such as
``password`` stands up to four tokens before it; all others are outside by constraint. The
chain falls apart there, so only the stretches between are decoded, each token once: the result
is that of the whole chain, in time linear in the text. What the field tags is given as kind
``crf``, besides the base spans, whether it meets one of them or not.

The field is trained here, by gradient steps on sentences generated from templates with a
fixed seed: assignments, headers, connection strings, keys cut in parts and passwords of letters
or digits only on one side; mail addresses, phone numbers, versions, dates, names, and prose
about keys and passwords on the other. No table is read for it; scanning is one narrow pass.

Defined results: a null text counts as empty, without spans; texts and tokens of any length are
read whole, the tokens block by block; places are code points, ends exclusive; of spans that
begin at one place those of the base come first; repeated rows give equal rows; an empty
table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import batch, documents, mapped, small_batches, texts

KINDS = ("assign", "access", "hex", "crf")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Every assign match has one of these, lower-cased.
_CUES = ("passw", "secret", "token", "api")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns, in order."""
    out: list[Span] = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


_TOKEN = re.compile(r"[\w+/.\-]+=*|[^\w\s]")
#: Words, perhaps with marks in them, in one case each; numbers with their marks.
_WORD = r"(?>[A-Z]+(?![^\W\d_])|[^\W\d_]?+[^\W\d_A-Z]*+)"
_WORDS = re.compile(rf"{_WORD}(?>[._/+=\-]{_WORD})*+")
_NUMBER = re.compile(r"[\d.,:/+=\-]+")
_CUE = re.compile(r"(?:.*[_.\-/])?(?:password|passwd|passphrase|passcode|pwd|pass|pin|secret|token|key|api_?key|bearer|authorization|auth|credentials?|(?:access|private|secret|api|auth|client)_?(?:key|token|secret|id))", re.DOTALL)
_CAMEL_CUE = re.compile(r".*[a-z](?:Key|Token|Secret|Password|Pwd|Pass)", re.DOTALL)
_SHAPES = re.compile(r"[a-z]+|[A-Z]+|\d+|[^\w]+|_+")
_ISSUER = re.compile(r"(AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|eyJ|AIza|glpat-)")

#: A word longer than this may be a secret by itself.
LONG = 28
#: Tokens that the field looks back over for a cue, and the least length of what it may tag.
BACK, LEAST = 4, 4
#: What a token may be by itself: a secret, or a word that such follow.
MAY, CUE = 1, 2
#: Tokens that are taken at once, and kinds of tokens that a worker remembers.
BLOCK, CACHE = 1 << 15, 200_000

#: Marks that stand between a name and its value, or around a value.
_ASSIGNS, _QUOTES = frozenset(":=>"), frozenset("\"'`")


def kind_of(token: str) -> int:
    """MAY, CUE, both or neither, from a token alone, whatever its length."""
    out = CUE if _CUE.fullmatch(token.lower().strip("_-.=+/")) or _CAMEL_CUE.fullmatch(token) else 0
    if len(token) >= 6 and not _NUMBER.fullmatch(token) and (len(token) > LONG or not _WORDS.fullmatch(token)):
        out |= MAY
    return out


def _entropy(s: str) -> float:
    p = np.array(list(Counter(s).values())) / len(s)
    return float(-(p * np.log2(p)).sum())


def own_features(t: str) -> list[str]:
    """Names of the features of a token by itself."""
    kind = "may" if kind_of(t) & MAY else "number" if _NUMBER.fullmatch(t) else "word"
    runs = sum(1 for _ in _SHAPES.finditer(t))
    digits, upper, lower = sum(map(str.isdigit, t)), any(map(str.isupper, t)), any(map(str.islower, t))
    out = [kind, f"{kind}_length{min(len(t) // 4, 10)}", f"entropy{int(_entropy(t) * 2)}", f"runs{min(runs // 3, 5)}", f"digits{min(4, 5 * digits // len(t)) if digits else 'none'}"]
    marks = {"mixed": upper and lower, "hexadecimal": re.fullmatch(r"[0-9a-fA-F]+", t), "issuer": _ISSUER.match(t), "dotted": "." in t.rstrip("."), "slashed": "/" in t, "padded": t.endswith("="), "foreign": not t.isascii(), "wordy": re.search(r"[a-zA-Z]{7,}", t)}
    return out + [k for k, yes in marks.items() if yes]


def context_features(tokens: list[str], i: int, cue: int, free: bool) -> list[str]:
    """Names of the features of what stands around token ``i``: ``cue`` is how far back the
    nearest cue is (0: none), ``free`` whether the token before may be a secret, too."""
    out, last, after = [], tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""
    assigned = last != "" and (last[-1] in _ASSIGNS or (last in _QUOTES and i > 1 and tokens[i - 2][-1] in _ASSIGNS))
    if assigned:
        out.append("assigned")
    if last in _QUOTES and after in _QUOTES and last:
        out.append("quoted")
    if cue:
        out += ["cue", f"cue{cue}"]
        if assigned:
            out.append("cue_assigned")
        if last.lower() in ("bearer", "basic"):
            out.append("bearer")
        if last.lower() in ("is", "ist", "est", "es", "was"):
            out.append("cue_is")
    if after == "@" or last == "@":
        out.append("before_at" if after == "@" else "after_at")
        if last == ":":
            out.append("login")
    if free:
        out.append("after")
    return out


def file_features(text: str) -> list[str]:
    return [x for x, yes in (("file=", text.count("=") > 3), ("file{", "{" in text and "}" in text), ("file_key", "KEY" in text)) if yes]


def may_be_tagged(tokens: list[str], kinds: list[int], begin: int = 0) -> list[int]:
    """For each token from ``begin`` on, -1 if the constraint holds it outside, or how far back the nearest cue is (0: none).

    A token may be tagged that may be a secret by itself, or follows a cue within BACK
    tokens; either has LEAST characters and a letter or digit.
    """
    out, cue = [], -BACK - 1
    for i in range(max(0, begin - BACK), len(tokens)):
        if i >= begin:
            near = i - cue if i - cue <= BACK else 0
            t = tokens[i]
            free = (kinds[i] & MAY or near) and len(t) >= LEAST and (t[0].isalnum() or any(map(str.isalnum, t)))
            out.append(near if free else -1)
        if kinds[i] & CUE:
            cue = i
    return out


class Field:
    """A linear-chain field over three tags (0 outside, 1 begin, 2 inside)."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        self.rows = {k: tuple(emit[i].tolist()) for k, i in names.items()}
        self.moves = move.tolist()

    def add(self, names: list[str]) -> tuple[float, float, float]:
        a = b = c = 0.0
        for x in names:
            if x in self.rows:
                p, q, r = self.rows[x]
                a, b, c = a + p, b + q, c + r
        return a, b, c

    def scores(self, rows: list[list[str]]) -> list[tuple[float, float, float]]:
        return [_OUTSIDE if r == ["outside"] else self.add(r) for r in rows]

    def viterbi(self, scores: list, first: bool = True, last: bool = True) -> list[int]:
        """The best tags of a stretch; where it is not the ``first`` or ``last`` of its text, a token outside is next to it."""
        m = self.moves
        best = [scores[0][0], scores[0][1], scores[0][2] - 1e9] if first else [m[0][t] + scores[0][t] for t in range(3)]
        back = []
        for s in scores[1:]:
            step, new = [], []
            for t in range(3):
                a, b, c = best[0] + m[0][t], best[1] + m[1][t], best[2] + m[2][t]
                k = 0 if a >= b and a >= c else 1 if b >= c else 2
                step.append(k)
                new.append((a, b, c)[k] + s[t])
            best = new
            back.append(step)
        if not last:
            best = [x + m[t][0] for t, x in enumerate(best)]
        tags = [max(range(3), key=best.__getitem__)]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]


_OUTSIDE = (0.0, -1e9, -1e9)


def _sentences(seed: int, many: int):
    """Generated (tokens, tags, file features) for training."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    letters, base64 = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda a, n: "".join(a[int(k)] for k in rng.integers(len(a), size=n))
    part = lambda: pick(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"])
    word = lambda: "".join(part() for _ in range(int(rng.integers(1, 6))))
    cased = lambda: pick([word(), word(), word(), word().capitalize(), word().upper(), word() + ".", f"{word()}-{word()}"])
    number = lambda n: some("0123456789", n)
    cue = lambda: pick(["password", "api_key", "client_secret", "access_token", "key", "pwd", "PASS", "DB_PASSWORD", "secretKey", "auth.token", "passphrase", "pin"])
    quote = lambda x: (lambda q: [(q, 0), (x, 1), (q, 0)])(pick(['"', "'", "`"])) if rng.random() < 0.5 else [(x, 1)]
    for _ in range(many):
        left, right = [cased() for _ in range(int(rng.integers(0, 5)))], [cased() for _ in range(int(rng.integers(0, 4)))]
        n = int(rng.integers(12, 48))
        strong = pick([some(base64, n), some(letters, n), "ghp_" + some(base64, 36), "sk-" + some(base64, n), "AKIA" + some(base64[:26] + "0123456789", 16), "eyJ" + some(base64, n) + "." + some(base64, n), some("0123456789abcdef", 40), some(base64, n) + "==", some(base64[:52], n + 6), some(base64 + "+/", n + 10)])
        weak = pick([word() + word(), word().capitalize() + number(2), word() + number(3), number(int(rng.integers(4, 10))), some(letters[:26], 9), f"{word()}_{word()}", word() + word().capitalize()])
        kind = int(rng.integers(19))
        if kind < 3:
            middle = [(cue(), 0), (pick(["=", ":"]), 0), *quote(pick([strong, weak, weak]))]
        elif kind == 3:
            middle = [(cue() + "=", 0), *quote(pick([strong, weak]))]
        elif kind == 4:
            middle = [("Authorization", 0), (":", 0), (pick(["Bearer", "Basic"]), 0), (pick([strong, some(base64[:52], 24)]), 1)]
        elif kind == 5:
            middle = [("key", 0), (":", 0), (strong, 1), (some(base64, 20), 2), (some(base64, 20), 2)]
        elif kind == 6:
            middle = [(strong, 1)]
        elif kind == 7:
            middle = [(pick(["postgres", "mysql", "amqp", "https"]), 0), (":", 0), (f"//{word()}", 0), (":", 0), (pick([strong, weak, word() + number(2)]), 1), ("@", 0), (f"{word()}.{word()}", 0)]
        elif kind == 8:
            middle = [(f"{word()}.{number(2)}", 0), ("@", 0), (f"{word()}{number(1)}.{word()}.org", 0)]
        elif kind == 9:
            middle = [(pick([f"+{number(11)}", f"{number(3)}-{number(4)}", ".".join([number(3)] * 4), f"{number(16)}", f"{number(4)}-{number(2)}-{number(2)}"]), 0)]
        elif kind == 10:
            middle = [(pick([f"{word()}-{number(1)}.{number(1)}", f"v{number(1)}.{number(2)}.{number(1)}", f"{word()}{number(2)}", f"{word()}_{number(4)}"]), 0)]
        elif kind == 11:
            middle = [("http", 0), (":", 0), (f"//{word()}.{word()}.com/{word()}/{number(pick([3, 4]))}{pick(['', f'/{number(2)}/{word()}-{word()}-{word()}', f'/{word()}.html'])}", 0)]
        elif kind == 12:
            middle = [(f"{number(4)}-{number(2)}-{number(2)}T{number(2)}", 0), (":", 0), (f"{number(2)}Z", 0)]
        elif kind in (13, 14):  # cues in plain prose
            middle = [(pick(["the", "a", "your", "each", "new"]), 0), (pick(["key", "token", "password", "secret", "pass", "pin"]), 0), *[(pick([word(), word().capitalize(), number(4)]), 0) for _ in range(int(rng.integers(1, 4)))]]
        elif kind == 15:
            middle = [(pick([f"{word()}{word().capitalize()}", f"{word().capitalize()}{word().capitalize()}", f"{word().upper()}s", f"{word()}{number(int(rng.integers(1, 4)))}{word()}", "".join(word() for _ in range(8))]), 0)]
        elif kind == 16:
            middle = [(pick([cue(), "password"]), 0), ("is", 0), *quote(pick([weak, strong]))]
        elif kind == 17:  # values that follow other names
            middle = [(pick(["name", "title", "size", "page", "color", "count"]), 0), (pick(["=", ":"]), 0), (pick([word(), number(5), weak]), 0)]
        else:
            middle = [(pick(["key", "token"]), 0), (pick(["features", "points", "ring", "holders", "figures", "words"]), 0), (word(), 0)]
        rows = [(x, 0) for x in left] + middle + [(x, 0) for x in right]
        yield [t for t, _ in rows], [y for _, y in rows], pick([[], [], ["file="], ["file{"]])


def features(tokens: list[str], file: list[str]) -> list[list[str]]:
    """Names of the features of each token; those that the constraint holds outside have one of their own."""
    kinds = list(map(kind_of, tokens))
    near, out = may_be_tagged(tokens, kinds), []
    for i, c in enumerate(near):
        out.append(["outside"] if c < 0 else [*own_features(tokens[i]), *file, *context_features(tokens, i, c, i > 0 and near[i - 1] >= 0)])
    return out


@lru_cache(maxsize=4)
def train(seed: int = 5, sentences: int = 1000, steps: int = 80, ridge: float = 1e-3) -> Field:
    """The field of greatest likelihood on generated sentences, by Adam steps on the gradient."""
    data = [(features(t, file), y) for t, y, file in _sentences(seed, sentences)]
    names = {x: k for k, x in enumerate(sorted({f for rows, _ in data for r in rows for f in r}))}
    longest = max(len(y) for _, y in data)
    x = np.zeros((len(data), longest, len(names)), np.float32)
    tags, on = np.zeros((len(data), longest), int), np.zeros((len(data), longest), bool)
    for k, (rows, y) in enumerate(data):
        tags[k, : len(y)], on[k, : len(y)] = y, True
        for i, r in enumerate(rows):
            x[k, i, [names[f] for f in r]] = 1
    emit, move = np.zeros((len(names), 3)), np.zeros((3, 3))
    want = np.eye(3)[tags] * on[..., None]
    pairs = on[:, 1:]
    want_move = np.einsum("sia,sib->ab", want[:, :-1] * pairs[..., None], want[:, 1:])
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, move)]
    flat = x.reshape(-1, len(names))
    for step in range(1, steps + 1):
        s = (flat @ emit.astype(np.float32)).reshape(*on.shape, 3).astype(float)
        ahead = np.empty_like(s)
        ahead[:, 0] = s[:, 0]
        log_sum = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        for i in range(1, longest):
            new = log_sum(ahead[:, i - 1, :, None] + move, 1) + s[:, i]
            ahead[:, i] = np.where(on[:, i, None], new, ahead[:, i - 1])
        total = log_sum(ahead[:, -1], 1)
        back = np.zeros_like(s)
        for i in range(longest - 2, -1, -1):
            new = log_sum(move[None] + (s[:, i + 1] + back[:, i + 1])[:, None, :], 2)
            back[:, i] = np.where(on[:, i + 1, None], new, 0)
        have = np.exp(ahead + back - total[:, None, None]) * on[..., None]
        have_move = np.zeros((3, 3))
        for i in range(1, longest):
            joint = np.exp(ahead[:, i - 1, :, None] + move + (s[:, i] + back[:, i])[:, None, :] - total[:, None, None])
            have_move += (joint * on[:, i, None, None]).sum(0)
        grads = (flat.T @ (want - have).reshape(-1, 3) / len(data) - ridge * emit, (want_move - have_move) / len(data) - ridge * move)
        for p, g, (m, v) in zip((emit, move), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    # an inside tag follows a begin or inside tag only
    move[0, 2] = -1e9
    return Field(names, np.round(emit, 6), np.round(move, 6))


class Scanner:
    """A field with what its worker remembers of tokens."""

    def __init__(self, field: Field):
        self.field, self.kinds, self.own = field, {}, {}

    def _kinds(self, tokens: list[str]) -> list[int]:
        if len(self.kinds) > CACHE:
            self.kinds.clear()
        known = self.kinds
        out = list(map(known.get, tokens))
        if None in out:
            at = -1
            for _ in range(out.count(None)):
                at = out.index(None, at + 1)
                t = tokens[at]
                k = out[at] = known.get(t) if t in known else kind_of(t)
                if len(t) <= 64:
                    known[t] = k
        return out

    def _own(self, t: str) -> tuple[float, float, float]:
        s = self.own.get(t)
        if s is None:
            s = self.field.add(own_features(t))
            if len(t) <= 64:
                if len(self.own) > CACHE // 4:
                    self.own.clear()
                self.own[t] = s
        return s

    def tagged(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets that the field tags: the best tags of the whole chain.

        Tokens are taken block by block. What the constraint holds outside cuts the chain, so
        the stretches between are decoded one by one, each token once.
        """
        found, file = _TOKEN.finditer(text), None
        held: list[re.Match] = []
        begin, out, first = 0, [], True  # tokens of ``held`` before ``begin`` are done
        while True:
            new = list(islice(found, BLOCK))
            held += new
            tokens = [m[0] for m in held]
            kinds, end = self._kinds(tokens), len(new) < BLOCK
            if any(kinds):
                file = self.field.add(file_features(text)) if file is None else file
                begin = self._stretches(held, tokens, kinds, begin, first, end, file, out)
            else:
                begin = len(held) if end else max(begin, len(held) - 1)
            if end:
                return out
            keep = max(0, begin - BACK - 1)
            first = first and keep == 0
            held, begin = held[keep:], begin - keep

    def _stretches(self, held, tokens, kinds, begin, first, end, file, out) -> int:
        """Decodes the whole stretches from ``begin`` on, and gives the place of the first token that is left."""
        known = max(0, begin - 1)  # the last token that is done is a neighbour still
        near = [-1] * known + may_be_tagged(tokens, kinds, known)
        i, n = begin, len(tokens)
        while i < n:
            if near[i] < 0:
                i += 1
                continue
            j = i
            while j < n and near[j] >= 0:
                j += 1
            if j >= n and not end:
                return i
            scores = []
            for k in range(i, j):
                a, b = self._own(tokens[k]), self.field.add(context_features(tokens, k, near[k], k > 0 and near[k - 1] >= 0))
                scores.append((a[0] + b[0] + file[0], a[1] + b[1] + file[1], a[2] + b[2] + file[2]))
            tags = self.field.viterbi(scores, first and i == 0, j == n)
            for k, tag in enumerate(tags, i):
                if tag == 1:
                    last = k
                    while last + 1 < j and tags[last + 1 - i] == 2:
                        last += 1
                    out.append((held[k].start(), held[last].end()))
            i = j
        # the last token's feature of the next one isn't known yet: it is outside, or all is read
        return n if end else n - 1


def tagged_spans(text: str, field: Field) -> list[tuple[int, int]]:
    return Scanner(field).tagged(text)


def all_spans(text: str, scanner: Scanner) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and tagged spans, as (start, kind, end) in order."""
    base = base_spans(text)
    return base, sorted(base + [(a, 3, b) for a, b in scanner.tagged(text)])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf, n_new.

    ``n_crf`` are the spans that the field tags, ``n_new`` those of them that meet no base span.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64()), ("n_new", pa.int64())])
        own = Scanner(field)
        for b in batches:
            rows = {k: [] for k in schema.names[1:]}
            for t in texts(b.column(1)):
                base, every = all_spans(t, own)
                for k in range(3):
                    rows[f"n_{KINDS[k]}"].append(sum(x[1] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(every))
                more = [x for x in every if x[1] == 3]
                rows["n_crf"].append(len(more))
                rows["n_new"].append(sum(not any(a < e and s < b for s, _, e in base) for a, _, b in more))
            yield batch(schema, doc_id=b.column(0), **rows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long, n_new long", "secret_scan")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), train())
