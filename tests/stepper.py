"""The yardstick of the property tests, from definitions over arrays.

Rows are (service, start, end) in epoch seconds for one client. Records stand longest first where starts are equal. From one that counts, the next
that counts is the first behind it that begins later, ends later and has enough time of its own, which runs from the later of its start
and the end before. Its days are those of its own time, without a first day on which the time before ended.
"""

from collections import Counter
from itertools import groupby

import numpy as np

DAY = 86_400
QUARTER = 900


def arranged(rows):
    own = np.array([(s, e) for _, s, e in rows], np.int64).reshape(-1, 2)
    return own[np.lexsort((-own[:, 1], own[:, 0]))]


def successors(own, least):
    """Places of the records that count, each found from the one before."""
    at, begin, end = -1, 0, 0
    while True:
        s, e = own[at + 1:].T
        fits = np.flatnonzero((s > begin) & (e > end) & (e - np.maximum(s, end) >= least))
        if not len(fits):
            return
        at += 1 + int(fits[0])
        begin, end = own[at]
        yield at


def days_of(begin, end, before):
    """Days of the own time, as a set, less the day of the end before if it is the first."""
    first = begin // DAY
    return len({*range(first, end // DAY + 1)} - ({first} & {before // DAY}))


def own_times(own, least):
    kept = own[np.fromiter(successors(own, least), np.int64)]
    ends = np.concatenate([[0], kept[:-1, 1]])[:len(kept)]
    return kept[:, 0], np.maximum(kept[:, 0], ends), kept[:, 1], ends


def label_days(rows, anchor, window_days, stay="Stay"):
    low = anchor - window_days * DAY
    own = arranged([r for r in rows if r[0] == stay])
    own[:, 1] = np.minimum(own[:, 1], anchor)
    start, begin, end, before = own_times(own, -np.inf)
    begin = np.maximum(begin, low)
    inside = (np.maximum(start, end) // DAY >= low // DAY) & (end - begin >= QUARTER)
    return sum(days_of(*t) for t in np.stack([begin, end, before], 1)[inside].tolist())


def clipped(rows, services, hi, lo):
    """What lies in lo..hi of the records that touch it."""
    low = -np.inf if lo is None else lo
    return [(v, max(s, low), min(e, hi)) for v, s, e in rows if v in services and e >= low and max(s, low) <= hi]


def timed_total(rows, service, hi, lo=None, stay="Stay"):
    _, begin, end, before = own_times(arranged(clipped(rows, {service}, hi, lo)), QUARTER if service == stay else -np.inf)
    return sum(days_of(*t) for t in np.stack([begin, end, before], 1).tolist())


def counted(rows, services, hi, lo=None):
    """Runs of equal service and end, by start and service."""
    runs = groupby(sorted(clipped(rows, set(services), hi, lo), key=lambda r: (r[1], r[0], r[2])), key=lambda r: (r[0], r[2]))
    n = Counter(v for (v, _), _ in runs)
    return {v: n[v] for v in services}
