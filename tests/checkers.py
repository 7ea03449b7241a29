"""Plain loops over small data, written from the definitions, to compare the jobs with."""

import math
from datetime import timedelta

EPS = 1e-10


def close_to(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def daily_loop(bars):
    """bars: ordered dicts of one series with t, open, high, low, close, volume."""
    r, days = [], {}
    for i, b in enumerate(bars):
        before = bars[i - 1]["close"] if i else None
        ok = i and before > 0 and b["close"] > 0
        r.append(math.log(b["close"] / before) if ok else 0.0)
        days.setdefault(b["t"].date(), []).append(i)
    out = {}
    for day, rows in days.items():
        rs = [r[i] for i in rows]
        n, rv = len(rs), sum(x * x for x in rs)
        bv = math.pi / 2 * sum(abs(rs[k]) * abs(rs[k - 1]) for k in range(1, n))
        h, low = max(bars[i]["high"] for i in rows), min(bars[i]["low"] for i in rows)
        o, c = bars[rows[0]]["open"], bars[rows[-1]]["close"]
        pk = math.log(h / low) ** 2 / (4 * math.log(2)) if low > 0 else 0.0
        if low > 0 and o > 0:
            gk = 0.5 * math.log(h / low) ** 2 - (2 * math.log(2) - 1) * math.log(c / o) ** 2
        else:
            gk = 0.0
        obi = []
        for i in rows:
            b = bars[i]
            buy = b["volume"] * (b["close"] - b["low"]) / (b["high"] - b["low"] + EPS)
            sell = b["volume"] - buy
            obi.append((buy - sell) / (buy + sell + EPS))
        mean = sum(obi) / n
        cov = 0.0
        if n > 2:
            x, y = rs[1:], rs[:-1]
            mx, my = sum(x) / len(x), sum(y) / len(y)
            cov = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (len(x) - 1)
        out[day] = {
            "RV": rv, "BV": bv, "J_t": max(rv - bv, 0), "C_t": rv - max(rv - bv, 0), "PK": pk, "GK": gk,
            "OBI_mean": mean, "OBI_sq": sum(o * o for o in obi) / n,
            "OBI_std": math.sqrt(sum((o - mean) ** 2 for o in obi) / n), "OBI_abs": sum(map(abs, obi)) / n,
            "ILLIQ": sum(abs(r[i]) / (bars[i]["volume"] + EPS) for i in rows) / n * 1e6,
            "Roll": 2 * math.sqrt(max(-cov, 0)),
            "RS": math.sqrt(n) * sum(x**3 for x in rs) / (rv**1.5 + EPS),
            "RK": n * sum(x**4 for x in rs) / (rv**2 + EPS),
        }
    return out


def har_loop(log_rv):
    """log_rv: values in day order, None where missing; returns (d, w, m) per row."""
    out = []
    for i in range(len(log_rv)):
        def mean(n):
            part = log_rv[max(i - n, 0):i]
            return sum(part) / n if len(part) == n and None not in part else None

        out.append((log_rv[i - 1] if i else None, mean(5), mean(22)))
    return out


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def vpin_loop(rows, v_star=None):
    """rows: ordered (t, price, volume) of one series; volumes are whole numbers."""
    total = sum(v for _, _, v in rows)
    days = max((max(t for t, _, _ in rows) - min(t for t, _, _ in rows)) // timedelta(days=1), 1)
    size = v_star or max(total / days / 50, 1)
    cum, buckets = 0, {}
    for t, p, v in rows:
        cum += v
        buckets.setdefault(math.floor(cum / size), []).append((t, p, v))
    moves, gaps, daily = [], [], {}
    for k in sorted(buckets):
        part = buckets[k]
        moves.append(part[-1][1] - part[0][1])
        window, volume = moves[-250:], sum(v for _, _, v in part)
        gap = None
        if len(window) > 1:
            m = sum(window) / len(window)
            sd = math.sqrt(sum((x - m) ** 2 for x in window) / (len(window) - 1)) or 1e-10
            buy = volume * phi(moves[-1] / sd)
            gap = abs(buy - (volume - buy))
        gaps.append(gap)
        last = gaps[-50:]
        vpin = sum(last) / (50 * size) if len(last) == 50 and None not in last else None
        day = part[-1][0].date()
        daily[day] = vpin if vpin is not None else daily.get(day)
    first, end = min(daily), max(daily)
    return {
        first + timedelta(days=i): daily.get(first + timedelta(days=i)) for i in range((end - first).days + 1)
    }
