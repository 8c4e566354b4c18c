"""Brute-force pandas model of the cleaning and reporting rules, used as the
expected side of the tests on small fixtures."""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

import numpy as np
import pandas as pd

TOKENS = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
          "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}
LAYOUTS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%d %b %Y", "%b %d, %Y"]
NUM = re.compile(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def parse_date(s):
    if s is None:
        return None
    s = s.strip()
    for f in LAYOUTS:
        try:
            return datetime.strptime(s, f).date()
        except ValueError:
            pass
    return None


def num(s, default):
    if s is None:
        return default
    s = str(s).strip()
    return float(s) if NUM.match(s) else default


def clean_sales(rows: list[dict]) -> pd.DataFrame:
    """rows: dicts with canonical keys (raw strings or None), in file order."""
    out = []
    seen = set()
    for r in rows:
        r = {k: (None if (v is None or v in TOKENS) else v) for k, v in r.items()}
        if r.get("order_id") is None or r.get("revenue") is None:
            continue
        r.setdefault("unit_price", r["revenue"])
        oid = r["order_id"].strip()
        if oid in seen:
            continue
        seen.add(oid)
        d = parse_date(r.get("date"))
        if d is None:
            continue
        q = num(r.get("quantity", "1"), None)
        out.append(
            {
                "order_id": oid,
                "date": d,
                "product": (r.get("product") or "Unknown Product").strip().title(),
                "category": (r.get("category") or "General").strip().title(),
                "quantity": int(q) if q is not None else 1,
                "unit_price": num(r.get("unit_price"), 0.0),
                "revenue": num(r.get("revenue"), 0.0),
                "region": (r.get("region") or "Unknown Region").strip().title(),
            }
        )
    return pd.DataFrame(out)


def exact_sum(values) -> float:
    return float(sum((Decimal(repr(float(v))).quantize(Decimal("0.0001")) for v in values), Decimal(0)))


def share(part: float, total: float, digits: int = 2) -> float:
    return float(np.rint(part / total * 100.0 * 10**digits) / 10**digits) if total > 0 else 0.0
