"""DataFrame operators: profile, clean, features, segments, churn, KPIs, charts."""
