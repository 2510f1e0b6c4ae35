"""Plain Python versions of what the engine computes, for tests."""

from __future__ import annotations

import math
import random
import re

STOP = set("a an and are as at be by for from has in is it of on or that the to was with".split())


def tokens(text):
    return [t for t in re.findall("[a-z0-9]+", (text or "").lower()) if len(t) > 1 and t not in STOP]


def bm25(segments, query, mode, global_stats, k1=1.2, b=0.75):
    """segments: lists of token lists. Returns {(segment, doc): score}."""
    terms = sorted(set(tokens(query)))
    stats = {}
    whole_n = sum(map(len, segments))
    whole_len = sum(len(d) for s in segments for d in s)
    for i, s in enumerate(segments):
        n, total = (whole_n, whole_len) if global_stats else (len(s), sum(map(len, s)))
        df = {t: sum(t in d for x in (segments if global_stats else [s]) for d in x) for t in terms}
        stats[i] = n, total / n if n else 0.0, df
    out = {}
    for i, s in enumerate(segments):
        n, avg, df = stats[i]
        for j, d in enumerate(s):
            hit = [t for t in terms if t in d]
            if not hit or mode == "and" and len(hit) < len(terms):
                continue
            score = 0.0
            for t in hit:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                tf = d.count(t)
                norm = 1 - b + b * len(d) / avg if avg > 0 else 1.0
                score += idf * tf * (k1 + 1) / (tf + k1 * norm)
            out[i, j] = score
    return out


def random_events(n=300, sessions=12, seed=1):
    rng = random.Random(seed)
    kinds = ["view", "click", "search", "add_to_cart", "add_to_cart", "remove_from_cart", "purchase"]
    out, ts = [], 1_570_000_000
    for i in range(n):
        ts += rng.choice([0, 1, 30, 400])
        out.append(
            {
                "event_id": f"r_{i + 1:09d}", "ts": ts, "session_id": f"s{rng.randrange(sessions)}", "user_id": f"u{rng.randrange(4)}", "event_type": rng.choice(kinds),
                "device": rng.choice(["Mobile", "desktop", None]), "product_id": rng.choice(["p1", "p2", "p3", "p4", "", None]), "title": f"widget {rng.choice('abcdef') * 2} gadget{i % 7}",
                "category": rng.choice(["electronics.phone", "tools", None]), "brand": rng.choice(["acme", "bolt", None]), "price": rng.choice([None, 0.0, 9.99, 30.0, 130.76]), "query": None,
            }
        )
    return out


def states(events):
    """The state after each event, anew from all events of its session up to it; ``events`` are in order."""
    out, before = {}, {}
    for e in events:
        seen = before.setdefault(e["session_id"], [])
        seen.append(e)
        out[e["event_id"]] = state_after(seen)
    return out


def state_after(seen):
    kinds = [e["event_type"] for e in seen]
    bought = [i for i, k in enumerate(kinds) if k == "purchase"]
    open_ = [e for e in seen[bought[-1] if bought else 0 :] if e["product_id"]]
    cart = {}
    for e in open_:
        if e["event_type"] == "remove_from_cart":
            cart.pop(e["product_id"], None)
        elif e["event_type"] == "add_to_cart" and e["price"] is not None:
            cart[e["product_id"]] = e["price"]
    prices = [e["price"] for e in seen if e["price"] is not None]
    gaps = [max(0, b["ts"] - a["ts"]) for a, b in zip(seen, seen[1:], strict=False)]
    distinct = lambda f: len({e[f] for e in seen if e[f]})
    return {
        "user_id": seen[0]["user_id"], "device": seen[0]["device"], "first_ts": seen[0]["ts"], "last_ts": seen[-1]["ts"], "events": len(seen),
        "views": kinds.count("view"), "clicks": kinds.count("click"), "searches": kinds.count("search"), "cart_adds": kinds.count("add_to_cart"),
        "cart_removes": kinds.count("remove_from_cart"), "purchases": len(bought), "open_adds": sum(e["event_type"] == "add_to_cart" for e in open_),
        "cart_size": len(cart), "cart_value": float(sum(cart.values())), "products": distinct("product_id"), "categories": distinct("category"), "brands": distinct("brand"),
        "price_sum": float(sum(prices)), "price_count": len(prices), "price_max": float(max([0.0, *prices])), "gap_sum": sum(gaps), "gap_count": len(gaps), "gap_max": max([0, *gaps]),
    }
