"""Plain loops for the sequential rules, used to check the Spark operators on small input."""

import math
import re
from collections import Counter


def vec(text, dims=64):
    import hashlib

    v = [0] * dims
    for w in re.findall(r"\w+", text.lower()):
        v[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dims] += 1
    return v


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def cos(a, b, eps=0.0):
    den = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)) + eps
    return dot(a, b) / den if den else 0.0


def fifo(costs, window):
    """costs oldest first; kept positions oldest first."""
    total, kept = 0, []
    for pos in range(len(costs) - 1, -1, -1):
        if kept and total + costs[pos] > window:
            continue
        kept.append(pos)
        total += costs[pos]
    return total, kept[::-1]


def dedup(vecs, rank, turn, thr):
    n = len(vecs)
    keep, fresh = set(range(n)), {}
    for i in range(n):
        if i not in keep:
            continue
        for j in range(i + 1, n):
            if j in keep and cos(vecs[i], vecs[j]) > thr:
                win, lose = (i, j) if rank[i] >= rank[j] else (j, i)
                keep.discard(lose)
                fresh[win] = max(fresh.get(win, 0), turn[i], turn[j])
    return keep, fresh


def words4(t):
    return set(re.findall(r"[a-z0-9]{4,}", t.lower()))


class Replay:
    """One conversation, literal rules."""

    def __init__(self, cfg, vocab, archive=True):
        self.cfg, self.vocab, self.use = cfg, vocab, archive
        self.store, self.arch = [], []

    def density(self, t):
        words = re.findall(r"\w+", t)
        terms = set(re.findall("|".join(re.escape(v) for v in self.vocab), t, re.I))
        sents = re.split(r"(?<=[.!?])\s+", t.strip())
        return len(terms) / (len(words) or 1) * (sum(len(re.findall(r"\w+", s)) for s in sents) / (len(sents) or 1))

    def chunk(self, turn, text):
        return {"id": (turn, text), "text": text, "turn": turn, "last": turn, "hist": 0, "v": vec(text)}

    def add(self, turn, text):
        c = self.chunk(turn, text)
        self.store = [x for x in self.store if x["id"] != c["id"]] + [c]
        while len(self.store) > self.cfg.max_chunks:
            old = min(self.store, key=lambda x: x["last"])
            self.drop(old)

    def drop(self, c):
        self.store = [x for x in self.store if x is not c]
        if self.use and c["hist"]:
            self.arch.append(c)

    def boost(self, t):
        return 0.15 if any(v in t.lower() for v in self.vocab) else 0.0

    def assemble(self, q, turn, extra):
        cfg = self.cfg
        pool = self.store + extra
        qv = vec(q)
        raw = [cos(qv, c["v"], 1e-9) + self.boost(c["text"]) for c in pool]
        keep, fresh = dedup([c["v"] for c in pool], [self.density(c["text"]) for c in pool], [c["turn"] for c in pool], cfg.dedup_threshold)
        for k, t in fresh.items():
            if pool[k] not in extra:
                pool[k]["last"] = max(pool[k]["last"], t)
        recent_turns = sorted({c["turn"] for c in self.store})[-cfg.drift_recent_turns:]
        recent = [c for c in self.store if c["turn"] in recent_turns]
        drift = False
        if len(pool) >= 5 and recent:
            drift = 1 - cos(vec(" ".join(c["text"] for c in recent)), vec(" ".join(c["text"] for c in pool[: len(pool) // 2]))) > cfg.drift_threshold
        eff = {}
        for i in sorted(keep):
            c = pool[i]
            if c in extra:
                eff[i] = max(0.0, raw[i])
                continue
            age = turn - c["last"]
            e = raw[i] / cfg.decay_multiplier ** min(age / 10, 3.0)
            if drift and c not in recent:
                e *= 0.1
            eff[i] = max(0.0, e * (0.5 if age > cfg.stale_threshold else 1.0))
        used, sel = 0, []
        for i in sorted(eff, key=lambda i: -eff[i]):
            cost = max(1, len(pool[i]["text"]) // 4)
            if used + cost <= cfg.fixed_budget:
                used += cost
                sel.append(pool[i])
                if pool[i] not in extra:
                    pool[i]["hist"] += 1
        best = max(range(len(pool)), key=lambda i: raw[i]) if pool else None
        return {"sel": sel, "used": used, "top": raw[best] if pool else 0.0, "best": pool[best] if pool else None,
                "raw": {id(c): r for c, r in zip(pool, raw)}, "drift": drift}

    def turn(self, turn, q, reply):
        cfg = self.cfg
        a, fired, back = self.assemble(q, turn, []), False, 0
        if self.use and self.arch:
            b = a["best"]
            echo = b is not None and b in self.store and b["text"] != q and words4(b["text"]) and len(words4(b["text"]) & words4(q)) / len(words4(b["text"])) >= 0.8
            if a["top"] < cfg.archive_gate or echo:
                fired = True
                hits = [c for c in self.arch if words4(c["text"]) & words4(q)]
                hits.sort(key=lambda c: (len(words4(c["text"]) & words4(q)), c["last"]), reverse=True)
                hits = hits[: cfg.archive_top_k]
                if hits:
                    a = self.assemble(q, turn, hits)
                    for c in a["sel"]:
                        if c in hits:
                            c["last"] = max(c["last"], turn)
                            back += 1
        self.add(turn, q)
        if reply:
            self.add(turn, reply)
        moved = 0
        if self.use:
            for c in list(self.store):
                if c in a["sel"] and a["raw"].get(id(c), 1.0) >= cfg.archive_gate:
                    continue
                if turn - c["last"] > cfg.stale_threshold and c["hist"]:
                    self.drop(c)
                    moved += 1
        return turn, a["used"], [c["text"] for c in a["sel"]], fired, back, moved, len(self.store), len(self.arch)


def counts(xs):
    return Counter(xs)
