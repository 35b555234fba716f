"""Common table expressions shared by the SQL counterparts."""

from __future__ import annotations

# Four centres in the scaled space (order: Recency, Tenure,
# Frequency, Monetary, FreeTransactionRatio, AvgOrderValue), used wherever a
# result has to be repeated by SQL.
FIXED_CENTRES = {
    0: [-0.6, 0.4, 1.0, 1.0, 0.0, 0.2],
    1: [-0.3, 0.2, 0.2, 0.3, 0.0, 0.0],
    2: [0.2, 0.0, -0.3, -0.2, 0.0, 0.1],
    3: [1.5, -0.3, -1.2, -1.2, 0.0, -0.4],
}
FEATURES = ["Recency", "Tenure", "Frequency", "Monetary", "FreeTransactionRatio", "AvgOrderValue"]
LOGGED = {"Tenure", "Frequency", "Monetary", "AvgOrderValue"}


def rounded(expression: str, digits: int) -> str:
    return f"round_even(({expression}) * 1e{digits}, 0) / 1e{digits}"


def money(expression: str) -> str:
    return f"CAST(sum(CAST({expression} AS DECIMAL(18,4))) AS DOUBLE)"


def logged(column: str) -> str:
    return f"ln(1.0 + {column})" if column in LOGGED else column


def band(column: str, bounds: list[tuple[int, str]], beyond: str) -> str:
    cases = " ".join(f"WHEN {column} <= {b} THEN {s}" for b, s in bounds)
    return f"CASE {cases} ELSE {beyond} END"


BAND_R = band("Recency", [(30, "0.1e0"), (90, "0.3e0"), (180, "0.55e0"), (365, "0.8e0")], "1e0")
BAND_F = band("Frequency", [(1, "1e0"), (3, "0.7e0"), (10, "0.45e0"), (25, "0.2e0")], "0.1e0")
BAND_M = band("Monetary", [(100, "1e0"), (500, "0.7e0"), (2000, "0.45e0"), (5000, "0.2e0")], "0.1e0")
ABSOLUTE = rounded(f"0.5e0 * ({BAND_R}) + 0.3e0 * ({BAND_F}) + 0.2e0 * ({BAND_M})", 4)


def risk(score: str) -> str:
    return f"CASE WHEN {score} >= 0.65 THEN 'High Risk' WHEN {score} >= 0.35 THEN 'Medium Risk' ELSE 'Low Risk' END"


def nearest(prefix: str = "") -> str:
    def distance(centre: list[float]) -> str:
        return " + ".join(f"({prefix}{f} - ({v})) * ({prefix}{f} - ({v}))" for f, v in zip(FEATURES, centre))

    d = {i: f"({distance(c)})" for i, c in FIXED_CENTRES.items()}
    return (
        f"CASE WHEN {d[0]} <= {d[1]} AND {d[0]} <= {d[2]} AND {d[0]} <= {d[3]} THEN 0 "
        f"WHEN {d[1]} <= {d[2]} AND {d[1]} <= {d[3]} THEN 1 WHEN {d[2]} <= {d[3]} THEN 2 ELSE 3 END"
    )


def capped(table: str, columns: list[str], part: str = "TRUE") -> str:
    """All features of ``table``, the given columns capped at their own p95."""
    caps = ", ".join(f"quantile_cont({c}, 0.95) AS cap_{c}" for c in columns)
    values = ", ".join(
        (f"CASE WHEN {c} > cap_{c} THEN cap_{c} ELSE CAST({c} AS DOUBLE) END AS {c}" if c in columns else c)
        for c in FEATURES
    )
    return f"SELECT CustomerID, {values} FROM {table}, (SELECT {caps} FROM {table} WHERE {part}) WHERE {part}"


def scaled(source: str, fitted_on: str, extra: str = "") -> str:
    stats = ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s_{f}" for f in FEATURES
    )
    values = ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATURES)
    return f"SELECT CustomerID, {extra}{values} FROM {source}, (SELECT {stats} FROM {fitted_on})"


def log_all(source: str) -> str:
    return f"SELECT CustomerID, {', '.join(f'{logged(f)} AS {f}' for f in FEATURES)} FROM {source}"


_CTES: dict[str, tuple[str, list[str]]] = {
    "retail": (
        """SELECT CAST(l_orderkey AS VARCHAR) AS InvoiceNo, CAST(l_partkey AS VARCHAR) AS StockCode,
       p_name AS Description, CAST(l_quantity AS INT) AS Quantity, o_orderdate AS InvoiceDate,
       CASE WHEN l_discount = 0.1 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / l_quantity END AS UnitPrice,
       o_custkey AS CustomerID, n_name AS Country,
       CASE WHEN l_discount = 0.1 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS TotalPrice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN part ON l_partkey = p_partkey""",
        [],
    ),
    "dirty_once": (
        """SELECT InvoiceNo, StockCode,
       CASE WHEN CAST(StockCode AS BIGINT) % 61 = 0 THEN -Quantity
            WHEN CAST(StockCode AS BIGINT) % 61 = 1 THEN 0 ELSE Quantity END AS Quantity,
       CAST(InvoiceDate AS VARCHAR) AS InvoiceDate, UnitPrice,
       CASE WHEN CAST(InvoiceNo AS BIGINT) % 50 = 0 THEN NULL ELSE CustomerID END AS CustomerID,
       Country, TotalPrice FROM retail""",
        ["retail"],
    ),
    "dirty": (
        "SELECT * FROM dirty_once UNION ALL SELECT * FROM dirty_once WHERE CAST(InvoiceNo AS BIGINT) % 97 = 0",
        ["dirty_once"],
    ),
    "purchases": (
        """SELECT user_id AS CustomerID, CAST(event_id AS VARCHAR) AS InvoiceNo, 1 AS Quantity,
       value AS UnitPrice, ts AS InvoiceDate, value AS TotalPrice
FROM events WHERE event_type = 'purchase'""",
        [],
    ),
    "facts": (
        f"""SELECT CustomerID, max(InvoiceDate) AS last_seen, min(InvoiceDate) AS first_seen,
       count(DISTINCT InvoiceNo) AS Frequency,
       coalesce({money("CASE WHEN UnitPrice > 0 THEN TotalPrice END")}, 0) AS Monetary,
       avg(CASE WHEN UnitPrice = 0 THEN 1 ELSE 0 END) AS FreeTransactionRatio
FROM retail GROUP BY CustomerID""",
        ["retail"],
    ),
    "snap": ("SELECT max(InvoiceDate) + INTERVAL 1 DAY AS snapshot FROM retail", ["retail"]),
    "rfm": (
        """SELECT CustomerID, date_sub('day', last_seen, snapshot) AS Recency,
       date_sub('day', first_seen, snapshot) AS Tenure, Frequency, Monetary, FreeTransactionRatio,
       CASE WHEN Frequency > 0 THEN Monetary / Frequency ELSE 0 END AS AvgOrderValue
FROM facts, snap WHERE CustomerID IS NOT NULL""",
        ["facts", "snap"],
    ),
    "logs": (log_all("rfm"), ["rfm"]),
    "z": (scaled("logs", "logs"), ["logs"]),
    "assigned": (f"SELECT *, {nearest()} AS Segment FROM z", ["z"]),
    "segmented": ("SELECT rfm.*, Segment FROM rfm JOIN assigned USING (CustomerID)", ["rfm", "assigned"]),
    "names": (
        """SELECT Segment, CASE row_number() OVER (ORDER BY avg(Monetary) DESC, Segment)
       WHEN 1 THEN 'High Value' WHEN 2 THEN 'Frequent Buyer' WHEN 3 THEN 'Regular' WHEN 4 THEN 'At Risk'
       ELSE 'Regular' END AS Segment_Name FROM segmented GROUP BY Segment""",
        ["segmented"],
    ),
    "norms": (
        """SELECT rfm.*, """
        + ", ".join(
            f"CASE WHEN hi_{c} = lo_{c} THEN 0.5 ELSE (CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}_norm"
            for c in ("Recency", "Frequency", "Monetary")
        )
        + " FROM rfm, (SELECT "
        + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in ("Recency", "Frequency", "Monetary"))
        + " FROM rfm)",
        ["rfm"],
    ),
    "scored": (
        f"""SELECT * EXCLUDE (Recency_norm, Frequency_norm, Monetary_norm),
       {rounded("0.5e0 * Recency_norm + 0.3e0 * (1 - Frequency_norm) + 0.2e0 * (1 - Monetary_norm)", 4)} AS ChurnScore
FROM norms""",
        ["norms"],
    ),
    "churned": (f"SELECT *, {risk('ChurnScore')} AS ChurnRisk FROM scored", ["scored"]),
    "enriched": (
        """SELECT churned.*, segmented.Segment, Segment_Name FROM churned
JOIN segmented USING (CustomerID) JOIN names ON segmented.Segment = names.Segment""",
        ["churned", "segmented", "names"],
    ),
    "split": (
        """SELECT rfm.*, CASE WHEN row_number() OVER (ORDER BY Recency, CustomerID)
       <= floor((SELECT count(*) FROM rfm) * 0.2e0) THEN 'test' ELSE 'train' END AS part FROM rfm""",
        ["rfm"],
    ),
    "train_logs": (
        log_all("(" + capped("split", ["Monetary", "Frequency", "Recency"], "part = 'train'") + ")"),
        ["split"],
    ),
    "test_logs": (
        log_all("(" + capped("split", ["Monetary", "Frequency", "Recency"], "part = 'test'") + ")"),
        ["split"],
    ),
    "scoring_logs": (
        log_all(
            "("
            + capped("rfm", ["Monetary", "Frequency", "Recency", "Tenure", "AvgOrderValue"]).replace(
                " FreeTransactionRatio,", " CAST(0 AS DOUBLE) AS FreeTransactionRatio,"
            )
            + ")"
        ),
        ["rfm"],
    ),
}


def sql(final: str, *needs: str) -> str:
    """``final`` behind the expressions it needs, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in _CTES[name][1]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return final
    ctes = ",\n".join(f"{name} AS MATERIALIZED (\n{_CTES[name][0]})" for name in order)
    return f"WITH {ctes}\n{final}"


def sql_after_cleaning(final: str, *needs: str) -> str:
    """The same, with the cleaned rows of ``dirty`` in the place of ``retail``."""
    raw = f"AS MATERIALIZED (\n{_CTES['retail'][0]})"
    once, both = _CTES["dirty_once"][0].replace("FROM retail", "FROM raw"), _CTES["dirty"][0]
    cleaned = """SELECT DISTINCT InvoiceNo, StockCode, Quantity, CAST(InvoiceDate AS TIMESTAMP) AS InvoiceDate, UnitPrice,
CustomerID, Country, TotalPrice FROM dirty WHERE CustomerID IS NOT NULL AND Quantity > 0"""
    before = f"raw {raw},\ndirty_once AS MATERIALIZED (\n{once}),\ndirty AS MATERIALIZED (\n{both}),\n"
    return sql(final, *needs).replace(f"retail {raw}", f"{before}retail AS MATERIALIZED (\n{cleaned})", 1)
