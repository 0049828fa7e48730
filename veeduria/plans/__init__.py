"""Query plans: reports, profiles, period studies and the catalogue."""


def register_all() -> None:
    """Import every module that registers catalogue entries."""
    import importlib

    for m in ("catalog", "scores_q", "reports", "profiles", "dossier_q", "periods", "sources_q",
              "stream_q", "extra_q", "graph_q", "loads_q", "detect_q",
              "network_q", "summaries"):
        importlib.import_module(f"veeduria.plans.{m}")
