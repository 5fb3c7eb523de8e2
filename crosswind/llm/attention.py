"""A small causal self-attention model over subword ids, trained and run in numpy.

One attention layer and one feed-forward layer, both with a residual; the next id is predicted as a class, a member of the
class, and whether it ends its word, so that words are prefix-free events. Windows of CONTEXT + STRIDE inputs overlap by
CONTEXT: each scores its last STRIDE ids, so every id is scored once and sees CONTEXT inputs at least where there are as many.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np

CONTEXT, STRIDE, WIDTH, HIDDEN = 32, 32, 16, 32
CLASSES, MEMBERS = 32, 64
IDS = CLASSES * MEMBERS
#: The last ids: end of the text; beginning of it; nothing (masked).
END, BEGIN, NOTHING = IDS - 1, IDS, IDS + 1
SHAPES = {
    "embed": (IDS + 2, WIDTH), "place": (CONTEXT + STRIDE, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH),
    "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, WIDTH), "classes": (CLASSES, WIDTH), "class_bias": (CLASSES,), "members": (CLASSES, MEMBERS, WIDTH), "member_bias": (CLASSES, MEMBERS), "last": (WIDTH,), "last_bias": (IDS,),
}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@cache
def subwords(path: str):
    """The byte-level vocabulary cut to its first IDS - 1 ranks, which is one by itself."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ranks = {a: b for a, b in ranks.items() if b < IDS - 1}
    return tiktoken.Encoding("own", pat_str=r" [^ ]*|[^ ]+", mergeable_ranks=ranks, special_tokens={})


@cache
def begins_word(path: str) -> np.ndarray:
    """Which ids begin with a space."""
    encoder = subwords(path)
    return np.array([encoder.decode_single_token_bytes(i)[:1] == b" " for i in range(IDS - 1)])


def word_ids(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words without spaces, each behind a space, one after the other, and how many each has."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    ids = np.array(subwords(path).encode_ordinary((b" " + b" ".join(words)).decode()), np.int32)
    return ids, np.diff(np.r_[np.flatnonzero(begins_word(path)[ids]), len(ids)])


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (np.zeros(s) if "b" in k and ("bias" in k or k == "b1") else rng.normal(0, 0.5 if k == "embed" else 1 / np.sqrt(s[-1]) / 2, s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES]).astype(np.float32, copy=False)


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = np.asarray(values[at : at + int(np.prod(s))], np.float32).reshape(s)
        at += int(np.prod(s))
    return out


def keep_memory() -> None:
    """Has the process keep what arrays of a batch free, rather than give it back and get it anew, page by page, for the next: glibc's
    allocator keeps blocks of the size of the largest one that was freed, and twice as much of its heap."""
    np.empty(8 << 20, np.uint8)


def held(x: np.ndarray) -> np.ndarray:
    """x, changed to be 80 at most; looking for more takes a fraction of the time of a minimum."""
    return np.minimum(x, 80, out=x) if x.max(initial=0) > 80 else x


_SEEN = (np.arange(CONTEXT + STRIDE)[None, :] <= np.arange(STRIDE)[:, None] + CONTEXT).astype(np.float32)
#: Where the pairs of an id's row of embed stand.
_PAIRS = np.arange((IDS + 2) * (WIDTH // 2)).reshape(-1, WIDTH // 2)


def _embedded(m: dict[str, np.ndarray], inputs: np.ndarray) -> np.ndarray:
    """Embeddings and places of the inputs with a column of ones beside, which sums what they are multiplied with; zeros for NOTHING."""
    rows = np.ones((IDS + 2, WIDTH + 1), np.float32)
    rows[:, :WIDTH] = m["embed"]
    places = np.zeros((CONTEXT + STRIDE, WIDTH + 1), np.float32)
    places[:, :WIDTH] = m["place"]
    x = np.take(rows, inputs, axis=0)
    x += places
    return x


def log_probs(m: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Natural log probabilities (windows, STRIDE); 0 where the target is NOTHING. inputs: (windows, CONTEXT + STRIDE).

    As the softmaxes of ``gradients``, with fewer passes over the arrays: scores are held below 80 rather than shifted by
    their maximum, and a column of ones beside the inputs sums the weights. A query meets a key through the product of their
    two matrices, and values leave through that of theirs, so inputs themselves are weighted and none is projected.
    """
    x = _embedded(m, inputs)
    if (nothing := inputs == NOTHING).any():
        x[nothing] = 0
    xq = np.ascontiguousarray(x[:, CONTEXT:, :WIDTH]).reshape(-1, WIDTH)
    q = (xq @ (m["q"] @ m["k"].T / np.float32(np.sqrt(WIDTH)))).reshape(-1, STRIDE, WIDTH)
    a = q @ x[..., :WIDTH].transpose(0, 2, 1)
    np.exp(held(a), out=a)
    a *= _SEEN
    h = (a @ x).reshape(-1, WIDTH + 1)
    u = xq + (h[:, :WIDTH] / np.maximum(h[:, WIDTH:], np.float32(1e-30))) @ (m["v"] @ m["o"])
    t, last = targets.ravel(), last.ravel()
    c = (t // MEMBERS).astype(np.int16)  # radix sort
    bounds = np.r_[0, np.cumsum(np.bincount(c, minlength=CLASSES + 1)[:CLASSES])]
    at = np.argsort(c, kind="stable")[: bounds[-1]]  # by class, without NOTHING
    t, last, c = t[at], last[at], c[at]
    z = u @ m["w1"]
    z += m["b1"]
    u += np.maximum(z, 0, out=z) @ m["w2"]
    u1 = np.ones((len(at), WIDTH + 1), np.float32)  # the last column is for biases
    u1[:, :WIDTH] = np.take(u, at, axis=0)
    logits = u1 @ np.concatenate([m["classes"], m["class_bias"][:, None]], axis=1).T
    got = held(logits)[np.arange(len(t)), c]
    got -= np.log(np.exp(logits, out=logits) @ np.ones(CLASSES, np.float32))
    x, heads = np.empty((len(t), MEMBERS), np.float32), np.concatenate([m["members"], m["member_bias"][:, :, None]], axis=2)
    for j in range(CLASSES):
        rows = slice(bounds[j], bounds[j + 1])
        if bounds[j + 1] > bounds[j]:
            np.dot(u1[rows], heads[j].T, out=x[rows])
    got += held(x).ravel()[np.arange(len(t)) * MEMBERS + t % MEMBERS]
    got -= np.log(np.exp(x, out=x) @ np.ones(MEMBERS, np.float32))
    y = u1 @ np.append(m["last"], np.float32(0)) + m["last_bias"][t]
    got -= np.where(t == END, 0, _softplus(np.where(last, -y, y)))
    out = np.zeros(targets.size, np.float32)
    out[at] = got
    return out.reshape(targets.shape)


def gradients(m: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, last: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the scored ids, and its gradients.

    Softmaxes are those of ``log_probs``; their weights stay undivided, and what they are multiplied with is divided by their
    sums instead. Of a weight's gradient the part that all of a softmax's share is one more column of that product.
    """
    x = _embedded(m, inputs)
    if some := (nothing := inputs == NOTHING).any():
        x[nothing] = 0
    root, x_only = np.float32(np.sqrt(WIDTH)), x[..., :WIDTH]
    xq = np.ascontiguousarray(x[:, CONTEXT:, :WIDTH]).reshape(-1, WIDTH)
    qk, vo = m["q"] @ m["k"].T / root, m["v"] @ m["o"]
    q = (xq @ qk).reshape(-1, STRIDE, WIDTH)
    both = np.empty((len(x), 2 * STRIDE, CONTEXT + STRIDE), np.float32)  # weights, then their gradients before the exponential
    a, da = both[:, :STRIDE], both[:, STRIDE:]
    np.matmul(q, x_only.transpose(0, 2, 1), out=a)
    np.exp(held(a), out=a)
    a *= _SEEN
    h = (a @ x).reshape(-1, WIDTH + 1)
    sums = np.maximum(h[:, WIDTH:], np.float32(1e-30))
    h = h[:, :WIDTH] / sums
    u1 = np.ones((len(xq), WIDTH + 1), np.float32)  # the last column is for biases
    u0 = np.add(xq, h @ vo, out=u1[:, :WIDTH])
    z = u1 @ np.concatenate([m["w1"], m["b1"][None]])
    np.maximum(z, 0, out=z)
    t, last = targets.ravel(), last.ravel()
    c = (t // MEMBERS).astype(np.int16)  # radix sort
    bounds = np.r_[0, np.cumsum(np.bincount(c, minlength=CLASSES + 1)[:CLASSES])].tolist()
    at = np.argsort(c, kind="stable")[: bounds[-1]]  # by class, without NOTHING
    t, last, c, n = t[at], last[at], c[at], np.float32(max(1, len(at)))
    u = np.take(u1, at, axis=0)
    u[:, :WIDTH] += np.take(z @ m["w2"], at, axis=0)
    rows, own = np.arange(len(t)), t % MEMBERS
    g: dict[str, np.ndarray] = {}

    def less(p: np.ndarray, hit: np.ndarray) -> tuple[float, np.ndarray]:
        """p from logits to gradients of the loss but for a factor of each row; the loss and these factors."""
        at = rows * p.shape[1] + hit
        chosen = held(p).ravel()[at]
        np.exp(p, out=p)
        total = p @ np.ones(p.shape[1], np.float32)
        p.ravel()[at] -= total
        return float(np.log(total).sum() - chosen.sum()), (1 / (total * n))[:, None]

    heads = np.concatenate([m["classes"], m["class_bias"][:, None]], axis=1)
    p = u @ heads.T
    loss, share = less(p, c)
    grad = p.T @ (u * share)
    g["classes"], g["class_bias"] = grad[:, :WIDTH], grad[:, WIDTH]
    du = p @ m["classes"]
    du *= share
    heads, p = np.concatenate([m["members"], m["member_bias"][:, :, None]], axis=2), np.empty((len(t), MEMBERS), np.float32)
    members = [(j, slice(bounds[j], bounds[j + 1])) for j in range(CLASSES) if bounds[j + 1] > bounds[j]]
    for j, part in members:
        np.dot(u[part], heads[j].T, out=p[part])
    more, share = less(p, own)
    loss += more
    grad, own_u, own_du = np.zeros((CLASSES, MEMBERS, WIDTH + 1), np.float32), u * share, np.empty_like(du)
    for j, part in members:
        np.dot(p[part].T, own_u[part], out=grad[j])
        np.dot(p[part], m["members"][j], out=own_du[part])
    own_du *= share
    du += own_du
    g["members"], g["member_bias"] = grad[..., :WIDTH], grad[..., WIDTH]
    y = u[:, :WIDTH] @ m["last"] + m["last_bias"][t]
    dy = np.where(t == END, 0, 1 / (1 + np.exp(-np.clip(y, -30, 30))) - last).astype(np.float32) / n
    loss += float(np.where(t == END, 0, _softplus(np.where(last, -y, y))).sum())
    g["last"] = dy @ u[:, :WIDTH]
    g["last_bias"] = np.bincount(t, dy, IDS).astype(np.float32)
    du += dy[:, None] * m["last"]
    d = np.zeros((targets.size, WIDTH), np.float32)
    d[at] = du
    g["w2"] = z.T @ d
    dz = d @ m["w2"].T
    dz *= z > 0
    grad = u1.T @ dz
    g["w1"], g["b1"] = grad[:WIDTH], grad[WIDTH]
    du0 = d + dz @ m["w1"].T
    grad = h.T @ du0
    g["v"], g["o"] = grad @ m["o"].T, m["v"].T @ grad
    dh = np.empty((len(du0), WIDTH + 1), np.float32)
    np.matmul(du0, vo.T, out=dh[:, :WIDTH])
    dh[:, WIDTH] = -np.einsum("ij,ij->i", dh[:, :WIDTH], h)
    dh /= sums
    dh = dh.reshape(-1, STRIDE, WIDTH + 1)
    np.matmul(dh, x.transpose(0, 2, 1), out=da)
    da *= a
    dq = (da @ x_only).reshape(-1, WIDTH)
    dx = both.transpose(0, 2, 1) @ np.concatenate([dh[..., :WIDTH], q], axis=1)
    if some:
        dx[nothing] = 0
    grad = xq.T @ dq / root
    g["q"], g["k"] = grad @ m["k"], grad.T @ m["q"]
    dx[:, CONTEXT:] += (du0 + dq @ qk.T).reshape(-1, STRIDE, WIDTH)
    g["place"] = dx.sum(0)
    pairs = np.zeros(_PAIRS.size, np.complex64)  # two numbers at a time
    np.add.at(pairs, np.take(_PAIRS, inputs.ravel(), axis=0).ravel(), dx.reshape(-1).view(np.complex64))
    g["embed"] = pairs.view(np.float32).reshape(-1, WIDTH)
    return loss / float(n), g


class Adam:
    """Steps as of Adam; changes model, whose moments are held as one array each."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model, self.n = model, 0
        self.first, self.second = np.zeros((2, sum(x.size for x in model.values())), np.float32)

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        g, a, b = flat(grads), self.first, self.second
        a *= np.float32(0.9)
        a += g
        g *= g
        b *= np.float32(0.99)
        b += g
        np.sqrt(b, out=g)  # moments are sums: 0.1 and 0.01 of them are the means
        size = (1 - 0.9**self.n) / (0.1 * rate)
        g *= np.float32(size * np.sqrt(0.01 / (1 - 0.99**self.n)))
        g += np.float32(size * 1e-6)
        d = np.divide(a, g, out=g)
        at = 0
        for k in SHAPES:
            own = self.model[k]
            own -= d[at : at + own.size].reshape(own.shape)
            at += own.size


def train(model: dict[str, np.ndarray], windows: np.ndarray, rate: float, passes: int = 1, batch: int = 32, seed: int = 3) -> float:
    """Adam over windows of (inputs, targets, last) side by side; changes model and gives the mean loss of the last pass."""
    keep_memory()
    adam, rng, loss = Adam(model), np.random.default_rng(seed), 0.0
    steps, done = passes * -(-len(windows) // batch), 0
    for _ in range(passes):
        losses = []
        for k in np.array_split(rng.permutation(len(windows)), max(1, -(-len(windows) // batch))):
            part, grads = gradients(model, *parts(windows[k]))
            adam.step(grads, rate * (1 - 0.9 * done / max(1, steps)))
            losses.append(part)
            done += 1
        loss = float(np.mean(losses)) if losses else 0.0
    return loss


def _softplus(x: np.ndarray) -> np.ndarray:
    """log(1 + exp(x)) for 32-bit numbers, in array operations that are quick for these."""
    return np.maximum(x, 0) + np.log(1 + np.exp(-np.abs(x)))


def parts(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return windows[:, : CONTEXT + STRIDE], windows[:, CONTEXT + STRIDE : CONTEXT + 2 * STRIDE], windows[:, CONTEXT + 2 * STRIDE :]


def windows_of(ids: np.ndarray, last: np.ndarray, begins: bool = True) -> np.ndarray:
    """All windows of one text's ids: rows of inputs, targets and whether a target ends its word."""
    n = -(-len(ids) // STRIDE)
    inputs = np.full(CONTEXT + n * STRIDE, NOTHING, np.int32)
    inputs[CONTEXT] = BEGIN if begins else NOTHING
    inputs[CONTEXT + 1 : CONTEXT + len(ids)] = ids[:-1]
    targets, ends = np.full(n * STRIDE, NOTHING, np.int32), np.zeros(n * STRIDE, np.int32)
    targets[: len(ids)], ends[: len(ids)] = ids, last
    seen = np.lib.stride_tricks.sliding_window_view(inputs, CONTEXT + STRIDE)[::STRIDE]
    return np.concatenate([seen, targets.reshape(n, STRIDE), ends.reshape(n, STRIDE)], axis=1)


def windows_of_all(ids: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of many texts at once, as ``windows_of`` gives them for each, and how many each has. A text's ids stand from one
    of bounds to the next; none is without."""
    sizes = np.diff(bounds)
    n = -(-sizes // STRIDE)
    places = np.arange(len(ids)) - np.repeat(bounds[:-1], sizes)
    begins = np.cumsum(CONTEXT + n * STRIDE) - n * STRIDE  # where a text's inputs begin, behind a context of nothing
    inputs = np.full(CONTEXT * len(n) + STRIDE * n.sum(), NOTHING, np.int32)
    at = np.repeat(begins + 1, sizes) + places
    inputs[np.delete(at, bounds[1:] - 1)] = np.delete(ids, bounds[1:] - 1)
    inputs[begins] = BEGIN
    firsts = np.cumsum(n) - n
    out = np.empty((n.sum(), CONTEXT + 3 * STRIDE), np.int32)
    seen = np.lib.stride_tricks.sliding_window_view(inputs, CONTEXT + STRIDE)
    out[:, : CONTEXT + STRIDE] = seen[np.repeat(begins - CONTEXT - firsts * STRIDE, n) + np.arange(len(out)) * STRIDE]
    targets, ends = np.full(len(out) * STRIDE, NOTHING, np.int32), np.zeros(len(out) * STRIDE, np.int32)
    at = np.repeat(firsts * STRIDE, sizes) + places
    targets[at], ends[at] = ids, last
    out[:, CONTEXT + STRIDE : CONTEXT + 2 * STRIDE], out[:, CONTEXT + 2 * STRIDE :] = targets.reshape(-1, STRIDE), ends.reshape(-1, STRIDE)
    return out, n
