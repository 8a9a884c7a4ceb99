"""Sequential reference HDBSCAN (Prim MST + union-find condensation + EOM) for cross-checks."""
import math
import numpy as np


def hdbscan_ref(X, mcs=5, ms=3):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    core = np.sort(D, axis=1)[:, ms - 1]
    M = np.maximum(np.maximum(core[:, None], core[None, :]), D)
    # Prim
    in_tree = np.zeros(n, bool); in_tree[0] = True
    best = M[0].copy(); src = np.zeros(n, int); edges = []
    for _ in range(n - 1):
        cand = np.where(in_tree, np.inf, best)
        j = int(np.argmin(cand)); edges.append((best[j], src[j], j)); in_tree[j] = True
        upd = M[j] < best; best[upd] = M[j][upd]; src[upd] = j
    edges.sort()
    # single linkage merges -> condensed tree, bottom-up with union-find (as in the engine)
    parent = list(range(n)); size = [1] * n; cid = [None] * n; mem = [[i] for i in range(n)]
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]; x = parent[x]
        return x
    pts, cls, nxt = [], [], [0]
    def new():
        nxt[0] += 1; return nxt[0]
    for w, a, b in edges:
        a, b = find(a), find(b)
        lam = math.inf if w <= 0 else 1.0 / w
        ba, bb = size[a] >= mcs, size[b] >= mcs
        if ba and bb:
            x = new(); cls += [(cid[a], x, lam, size[a]), (cid[b], x, lam, size[b])]; nc, nm = x, None
        elif ba or bb:
            k, s = (a, b) if ba else (b, a); nc, nm = cid[k], None; pts += [(m, nc, lam) for m in mem[s]]
        elif size[a] + size[b] >= mcs:
            x = new(); nc, nm = x, None; pts += [(m, x, lam) for m in mem[a] + mem[b]]
        else:
            nc, nm = None, mem[a] + mem[b]
        parent[b] = a; size[a] += size[b]; cid[a], mem[a] = nc, nm
    r = find(0)
    if size[r] < mcs:
        return np.full(n, -1)
    root = cid[r]
    birth = {root: 0.0}; par = {}
    for c, p, lam, s in cls:
        birth[c] = lam; par[c] = p
    stab = {c: 0.0 for c in birth}
    for m, c, lam in pts:
        stab[c] += lam - birth[c]
    for c, p, lam, s in cls:
        stab[p] += (lam - birth[p]) * s
    kids = {c: [] for c in birth}
    for c, p, _, _ in cls:
        kids[p].append(c)
    order = sorted([c for c in birth if c != root])          # creation order = bottom-up
    sel = {}; eff = dict(stab)
    for c in order:
        sub = sum(eff[k] for k in kids[c])
        if kids[c] and sub > stab[c]:
            sel[c] = False; eff[c] = sub
        else:
            sel[c] = True
            stack = list(kids[c])
            while stack:
                k = stack.pop(); sel[k] = False; stack += kids[k]
    lab = np.full(n, -1)
    for m, c, lam in pts:
        x = c
        while x is not None and x != root:
            if sel.get(x):
                lab[m] = x; break
            x = par.get(x)
    return lab


def hdbscan_topdown(X, mcs=5, ms=3):
    """HDBSCAN from its definition, top down: at falling distance, a cluster loses points, splits into
    components of at least ``mcs`` points, or ends."""
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    core = np.sort(D, axis=1)[:, ms - 1]
    M = np.maximum(np.maximum(core[:, None], core[None, :]), D)

    def parts(S, w):
        left, out = set(S), []
        while left:
            todo, part = [left.pop()], []
            while todo:
                p = todo.pop()
                part.append(p)
                near = {q for q in left if M[p, q] < w}
                left -= near
                todo += near
            out.append(part)
        return out

    def grow(S, birth):
        start, stability = list(S), 0.0
        for w in sorted(set(M[np.ix_(S, S)][np.triu_indices(len(S), 1)]), reverse=True):
            big = [p for p in parts(S, w) if len(p) >= mcs]
            if len(big) == 1 and len(big[0]) == len(S):
                continue
            lam = math.inf if w <= 0 else 1 / w
            if len(big) == 1:
                stability += (len(S) - len(big[0])) * (lam - birth)
                S = big[0]
                continue
            return start, stability + len(S) * (lam - birth), [grow(p, lam) for p in big]
        return start, stability, []

    def best(node):
        """(value, chosen clusters) below and including a node."""
        start, stability, kids = node
        below = [best(k) for k in kids]
        if kids and sum(v for v, _ in below) > stability:
            return sum(v for v, _ in below), [c for _, cs in below for c in cs]
        return stability, [start]

    label = np.full(n, -1)
    for i, c in enumerate(c for kid in grow(list(range(n)), 0.0)[2] for c in best(kid)[1]):
        label[c] = i
    return label
