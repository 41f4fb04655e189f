import datetime as dt
import math
from collections import Counter

from helpers import T0, ev, frame
from seqwise.operators.labels import future_labels
from seqwise.operators.vocab import build_vocab


def brute_future(rows, vocab, h):
    ids = {(f, v): i for f, v, i in vocab}
    by_user = {}
    for r in rows:
        by_user.setdefault(r[1], []).append(r)
    out = {}
    for evs in by_user.values():
        evs.sort(key=lambda r: (r[4], r[0]))
        for i, cur in enumerate(evs):
            fut = evs[i + 1:i + 1 + h]
            names = [e[3] for e in fut]
            chans = [e[6] for e in fut if e[6] is not None]
            mode = None
            if chans:
                c = Counter(chans)
                top = max(c.values())
                mode = min(k for k, v in c.items() if v == top)
            hour = fut[0][4].hour if fut else None
            out[cur[0]] = (
                1.0 if "purchase" in names else 0.0,
                1.0 if not fut else 0.0,
                ids.get(("event_name", fut[0][3]), 1) if fut else 0,
                ids.get(("channel", mode), 1) if mode is not None else 0,
                float(len(fut)),
                float(math.floor((fut[0][4] - cur[4]).total_seconds() / 86400)) if fut else 0.0,
                0,
                (0 if hour < 6 else 1 if hour < 12 else 2 if hour < 18 else 3) if fut else 0,
            )
    return out


def test_future_labels_match_bruteforce(spark):
    rows = []
    chans = ["app", "browser", "browser", "app", None, None, None, "app", "browser", None]
    names = ["pageview", "purchase", "scroll", "search", "purchase", "error", "pageview", "scroll", "x", "y"]
    for i in range(10):
        rows.append(ev(i, 1, T0 + dt.timedelta(hours=13 * i), names[i], channel=chans[i]))
    rows.append(ev(50, 2, T0, "purchase"))  # single event: empty future
    df = frame(spark, rows)
    vocab = build_vocab(df)
    vrows = [(r.feature, r.value, r.id) for r in vocab.collect()]
    got = {r.event_id: tuple(r)[2:] for r in future_labels(df, vocab, horizon=3).collect()}
    exp = brute_future(rows, vrows, 3)
    assert got == exp
    split = {r.event_id: tuple(r)[2:] for r in future_labels(df, vocab, horizon=3, rows_per_split=3).collect()}
    assert split == exp
