"""Adaptive context-mixing range coder for id sequences.

A sequence is cut into blocks that are coded independently, each from a fresh state.  In a block the next id is predicted by
order 2 and order 1 (the id last seen after the last two ids, and after the last one, with a confidence that grows on hits
and falls on misses) and by order 0: a few frequency tables, learned from the sequence and held once in its header, of which a
block takes the one that told its recent ids best.  Mixing weights follow how often a prediction of that confidence was right.
The mixed distribution is a line of intervals, order 2's id, order 1's and all ids by order 0; a range coder codes the widest
interval of an id.

All blocks advance in lockstep as numpy lanes.  Contexts are learned with every id; weights and the choice of a table change
every ``BATCH`` ids, so that the encoder works on whole batches.  All of it is integer arithmetic.
"""
from __future__ import annotations

import numpy as np

U = np.uint64
TOTAL_BITS, ORDER0_BITS, SLOT_BITS, CONF_BITS = 30, 18, 9, 3
BATCH = 128
#: Order-0 tables, at most; their costs share one number, a quarter of its bits each.
TABLES = 4
WORD = U(32)
LEAST = U(1 << 32)       # a range below it puts out 32 bits
LOWER = U((1 << 32) - 1)
CONFIDENCE = 1 << CONF_BITS
# For what ``Model.see`` finds: whether the id gives way, and how the confidence changes. A missed prediction of confidence 2 or
# more starts again at 1, others give way.
REPLACED = np.zeros(2 * CONFIDENCE, np.int32)
REPLACED[CONFIDENCE:CONFIDENCE + 2] = -1
STEP = np.r_[np.ones(CONFIDENCE - 1), 0, 1, 1, 1 - np.arange(2, CONFIDENCE)].astype(np.int32)


class Model:
    """State of all lanes; first axes of length 2 are orders 1 and 2. ``freq``: a row of frequencies for each order-0 table."""

    def __init__(self, lanes: int, freq: np.ndarray):
        self.lanes = lanes
        self.base = (np.arange(2 * lanes, dtype=np.int64) << SLOT_BITS).reshape(2, lanes)
        # prediction and confidence in one number; confidence 0: nothing seen yet
        self.table = np.zeros(2 * lanes << SLOT_BITS, np.int32)
        self.share = (np.arange(2 * lanes, dtype=np.int64) * CONFIDENCE).reshape(2, lanes)
        self.cell = (np.arange(2 * lanes, dtype=np.int64) * 2 * CONFIDENCE).reshape(2, lanes)
        # the share, of 65536, of right predictions at each confidence; none at 0
        self.right = np.tile(np.r_[0, np.linspace(4096, 57344, CONFIDENCE - 1)].astype(np.int64), 2 * lanes)
        n = freq.shape[1]
        mixed = np.arange(n, dtype=np.int64) * 40503
        mixed ^= mixed >> 9
        mask = (1 << SLOT_BITS) - 1
        # of each id, SLOT_BITS each: its slot in order 1, and its parts of the slot in order 2 as last id and as the one before; of no id: 0
        self.hashes = np.r_[mixed & mask | (mixed * 5 & mask) << SLOT_BITS | (mixed * 30011 >> 4 & mask) << 2 * SLOT_BITS, 0]
        # eighths of a bit that each table takes for an id: a batch adds up to less than 2^16
        bits = np.round(8 * (ORDER0_BITS - np.log2(freq))).astype(np.int64)
        self.bits = sum(b << 16 * k for k, b in enumerate(bits))
        self.tables, self.different = freq.shape
        self.cost = np.zeros((len(freq), lanes), np.int64)
        self.row = np.zeros(lanes, np.int64)  # where the lane's table begins in the flat tables
        # an id's frequency in the lower bits, where its interval begins above them
        self.interval = ((np.cumsum(freq, 1) - freq) << ORDER0_BITS + 1 | freq).reshape(-1)
        self.hash = np.zeros((1, lanes), np.int64)  # of the last id

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the tables (steps, orders, lanes) for the hashes of ids, a row more than steps."""
        mask = (1 << SLOT_BITS) - 1
        last = hashes[1:]
        out = np.empty((len(last), 2, self.lanes), np.int64)
        np.bitwise_and(last, mask, out=out[:, 0])
        two = last >> SLOT_BITS
        two += hashes[:-1] >> 2 * SLOT_BITS
        np.bitwise_and(two, mask, out=out[:, 1])
        out += self.base
        return out

    def see(self, slot: np.ndarray, v: np.ndarray, c: np.ndarray, coded: np.ndarray) -> np.ndarray:
        """One step of the tables: entries ``v`` of confidence ``c``; ``coded`` is the id, shifted.  Returns what was found:
        the confidence of a right prediction, and that of a wrong one plus ``CONFIDENCE``."""
        changed = v ^ coded
        found = np.minimum(changed, c + np.int32(CONFIDENCE))
        changed &= REPLACED.take(found)
        changed ^= v
        changed += STEP.take(found)
        self.table[slot] = changed
        return found

    def masses(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For entries of confidence ``c`` (orders, lanes): masses of both predictions and of order 2's, and the unit of order 0."""
        right = self.right.take(c + self.share)
        two = right[..., 1, :] << TOTAL_BITS - 16
        left = (1 << TOTAL_BITS) - two
        one = left * right[..., 0, :]
        one >>= 16
        left -= one
        one += two
        left >>= ORDER0_BITS
        return one, two, left

    def order0(self, at: np.ndarray, unit: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mass of an id by its place in the tables and where it starts, behind the predictions' mass ``ahead``."""
        start = self.interval.take(at)
        mass = start & ((2 << ORDER0_BITS) - 1)
        mass *= unit
        start >>= ORDER0_BITS + 1
        start *= unit
        start += ahead
        return mass, start

    def learn(self, ids: np.ndarray, found: np.ndarray) -> None:
        """After a batch: ``ids`` (steps by lanes) and what ``see`` returned for them (steps, orders, lanes), each in its lane's cell."""
        n = np.bincount(found.reshape(-1), minlength=2 * len(self.right)).reshape(-1, 2, CONFIDENCE)
        hits = n[:, 0].reshape(-1)
        n = n.sum(1).reshape(-1)
        self.right += (60000 * hits + 600 * (n - hits) - self.right * n) // (n + 16)
        self.right[::CONFIDENCE] = 0
        if self.tables > 1:
            own = self.bits.take(ids).sum(0)
            for k in range(self.tables):
                self.cost[k] = (self.cost[k] >> 1) + (own >> 16 * k & 0xFFFF)
            self.row = self.cost.argmin(0) * self.different


def order0(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2^ORDER0_BITS."""
    whole = 1 << ORDER0_BITS
    if len(counts) > whole // 2:
        raise ValueError("too many different ids in one sequence")
    f = 1 + (counts * ((whole - len(counts)) / counts.sum())).astype(np.int64)
    f[np.argmax(f)] += whole - f.sum()
    return f


def order0_tables(symbols: np.ndarray, sizes: np.ndarray, different: int, tables: int = TABLES, rounds: int = 1, least: int = 4096) -> np.ndarray:
    """Frequencies, a row for each table, for parts of a sequence (``sizes`` ids each) that differ in kind.

    Starts from all ids; the part that is told worst founds the next table; then parts go to the table that tells them best,
    and tables are counted anew.  Short sequences get one table.
    """
    all_counts = np.bincount(symbols, minlength=different).astype(np.float64)
    if tables < 2 or len(symbols) < least * tables:
        return order0(all_counts)[None]
    sizes = sizes[sizes > 0]
    start = np.cumsum(sizes) - sizes
    prior = all_counts / len(symbols)
    cost = lambda p: np.add.reduceat((-np.log2(p)).astype(np.float32).take(symbols), start)
    smooth = lambda c: 0.98 * c / c.sum() + 0.02 * prior
    told = [cost(prior)]
    for _ in range(tables - 1):
        worst = np.argmax(np.min(told, 0) - np.min(told, 0).sum() / len(symbols) * sizes)
        own = np.bincount(symbols[start[worst]:start[worst] + sizes[worst]], minlength=different)
        told.append(cost(0.5 * own / own.sum() + 0.5 * prior))
    for k in range(rounds):
        told = [cost(p) for p in shares] if k else told
        of = np.repeat(np.argmin(told, 0) * different, sizes)
        counts = np.bincount(of + symbols, minlength=len(told) * different).reshape(len(told), different)
        shares = [smooth(c) for c in counts if c.any()]
    return np.stack([order0(p * len(symbols)) for p in shares])


def shape(n: int, block: int) -> tuple[int, int]:
    """Lanes and steps; the last lane is filled up with zeros."""
    lanes = -(-n // block)
    return lanes, block if lanes > 1 else n


def encode(symbols: np.ndarray, freq: np.ndarray, block: int) -> list[bytes]:
    """The blocks' bytes. ``symbols`` index the columns of ``freq``, a row for each order-0 table."""
    lanes, steps = shape(len(symbols), block)
    padded = np.zeros(lanes * steps, np.int32)
    padded[:len(symbols)] = symbols
    padded = padded.reshape(lanes, steps)
    model = Model(lanes, freq)
    low, rng = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    width = steps + 4
    out = np.zeros(lanes * width, np.uint32)
    pos = np.arange(lanes) * width
    before = np.zeros_like(model.hash)
    for t0 in range(0, steps, BATCH):
        ids = np.ascontiguousarray(padded[:, t0:t0 + BATCH].copy().T)
        hashes = np.concatenate([model.hash, model.hashes.take(ids)])
        # the last one is of the next batch
        slots = model.slots(np.concatenate([before, hashes[:-1]]))
        model.hash, before = hashes[-1:], hashes[-2:-1]
        held, found, coded = np.empty(slots.shape, np.int32), np.empty(slots.shape, np.int64), ids << CONF_BITS
        sure = np.empty(slots.shape, np.int32)
        for t in range(len(ids)):
            held[t] = v = model.table.take(slots[t])
            c = np.bitwise_and(v, CONFIDENCE - 1, out=sure[t])
            np.add(model.see(slots[t], v, c, coded[t]), model.cell, out=found[t])
        both, m2, unit = model.masses(sure)
        mass, start = model.order0(model.row + ids, unit, both)
        for v, m, s in ((held[:, 0], both - m2, m2), (held[:, 1], m2, None)):
            i = np.flatnonzero(((v >> CONF_BITS) == ids) & (m > mass))
            mass.reshape(-1)[i] = m.reshape(-1).take(i)
            start.reshape(-1)[i] = 0 if s is None else s.reshape(-1).take(i)
        mass, start = mass.view(U), start.view(U)
        for t in range(len(ids)):
            r = rng >> U(TOTAL_BITS)
            low += r * start[t]
            rng = r * mass[t]
            i = np.flatnonzero(rng < LEAST)
            if len(i):
                x = low.take(i)
                w = _settled(x, rng.take(i))
                k = pos.take(i)
                out[k] = x >> WORD
                pos[i] = k + 1
                low[i] = x << WORD
                rng[i] = w << WORD
        model.learn(ids, found)
    for _ in range(2):
        out[pos] = low >> WORD
        pos += 1
        low <<= WORD
    return [out[i * width:p].astype("<u4").tobytes() for i, p in enumerate(pos.tolist())]


def _settled(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Ranges below 2^32, cut where they cross a multiple of 2^32, so that the upper half of ``low`` is final."""
    return np.minimum(rng, LEAST - (low & LOWER))


def decode(blocks: list[bytes], n: int, freq: np.ndarray, block: int) -> np.ndarray:
    """The symbols that ``encode`` was given."""
    lanes, steps = shape(n, block)
    words = np.frombuffer(b"".join(blocks) + b"\0" * 16, "<u4").astype(U)
    count = np.array([len(b) // 4 for b in blocks])
    at = np.cumsum(count) - count
    symbol = np.concatenate([np.repeat(np.arange(freq.shape[1], dtype=np.int32), f) for f in freq])  # of each unit of order 0
    model = Model(lanes, freq)
    low, rng, code = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U), np.zeros(lanes, U)
    for _ in range(2):
        code = (code << WORD) | words[at]
        at = at + 1
    out = np.empty((lanes, steps), np.int32)
    hashes = np.zeros((2, lanes), np.int64)  # of the last two ids
    for t0 in range(0, steps, BATCH):
        ids = np.empty((min(BATCH, steps - t0), lanes), np.int32)
        found = np.empty((len(ids), 2, lanes), np.int64)
        units = model.row // freq.shape[1] << ORDER0_BITS
        for t in range(len(ids)):
            slot = model.slots(hashes)[0]
            entry = model.table.take(slot)
            c = entry & (CONFIDENCE - 1)
            both, m2, unit = model.masses(c)
            r = rng >> U(TOTAL_BITS)
            v = ((code - low) // r).view(np.int64)
            # below both the difference wraps to a large number, whose symbol is replaced
            rest = v - both
            place = (rest.view(U) // unit.view(U)).view(np.int64)
            place += units
            x = symbol.take(place, mode="clip")
            mass, start = model.order0(model.row + x, unit, both)
            i = np.flatnonzero(rest < 0)
            m = m2.take(i)
            by2 = v.take(i) < m
            x[i] = np.where(by2, entry[1].take(i), entry[0].take(i)) >> CONF_BITS
            mass[i] = np.where(by2, m, both.take(i) - m)
            start[i] = np.where(by2, 0, m)
            np.add(model.see(slot, entry, c, x << CONF_BITS), model.cell, out=found[t])
            ids[t] = x
            hashes[0] = hashes[1]
            hashes[1] = model.hashes.take(x)
            low += r * start.view(U)
            rng = r * mass.view(U)
            i = np.flatnonzero(rng < LEAST)
            if len(i):
                y = low.take(i)
                w = _settled(y, rng.take(i))
                k = at.take(i)
                code[i] = (code.take(i) << WORD) | words.take(k, mode="clip")  # a damaged block may ask for more
                at[i] = k + 1
                low[i] = y << WORD
                rng[i] = w << WORD
        model.learn(ids, found)
        out[:, t0:t0 + len(ids)] = ids.T
    return out.reshape(-1)[:n]
