"""Query bindings. ``load_all`` imports every module so that its queries register."""

from importlib import import_module

MODULES = ["manifest", "source_plans", "scalar_plans", "rule_plans", "join_plans", "aggregate_plans",
           "window_plans", "sampling_plans", "stats_plans", "check_plans", "vector_plans",
           "evaluation_plans", "model_plans", "geo_plans", "stream_plans"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
