"""Training parameters: names, defaults, aliases, ranges."""

from __future__ import annotations

# Names and defaults of the parameters users already know.
DEFAULTS: dict = {
    "booster": "gbtree", "objective": "reg:squarederror", "num_class": 0, "num_target": 1, "base_score": None, "boost_from_average": True,
    "disable_default_eval_metric": False, "eval_metric": None, "multi_strategy": "one_output_per_tree", "seed": 0, "seed_per_iteration": False,
    "device": "cpu", "nthread": 0, "verbosity": 1, "validate_parameters": False,
    "tree_method": "auto", "process_type": "default", "updater_seq": "", "learning_rate": 0.3, "min_split_loss": 0.0, "max_depth": 6, "max_leaves": 0, "max_bin": 256,
    "grow_policy": "depthwise", "max_cat_to_onehot": 4, "max_cat_threshold": 64, "min_child_weight": 1.0, "reg_lambda": 1.0, "reg_alpha": 0.0, "max_delta_step": 0.0,
    "subsample": 1.0, "sampling_method": "uniform", "colsample_bytree": 1.0, "colsample_bylevel": 1.0, "colsample_bynode": 1.0, "refresh_leaf": True,
    "monotone_constraints": None, "interaction_constraints": None, "num_parallel_tree": 1, "max_cached_hist_node": None, "sparse_threshold": 0.2,
    "sample_type": "uniform", "normalize_type": "tree", "rate_drop": 0.0, "one_drop": False, "skip_drop": 0.0,
    "updater": None, "tolerance": 0.0, "feature_selector": "cyclic", "top_k": 0,
    "scale_pos_weight": 1.0, "tweedie_variance_power": 1.5, "quantile_alpha": None, "expectile_alpha": None, "huber_slope": 1.0,
    "aft_loss_distribution": "normal", "aft_loss_distribution_scale": 1.0,
    "lambdarank_pair_method": "topk", "lambdarank_num_pair_per_sample": None, "lambdarank_unbiased": False, "lambdarank_normalization": True,
    "lambdarank_score_normalization": True, "lambdarank_bias_norm": 1.0, "ndcg_exp_gain": True, "missing": float("nan"),
}
LINEAR_DEFAULTS = {"learning_rate": 0.5, "reg_lambda": 0.0, "reg_alpha": 0.0, "updater": "shotgun"}
ALIASES = {"lambda": "reg_lambda", "alpha": "reg_alpha", "gamma": "min_split_loss", "eta": "learning_rate", "random_state": "seed", "n_jobs": "nthread"}
RANGES = {
    "learning_rate": (0, None), "min_split_loss": (0, None), "max_depth": (0, 30), "max_leaves": (0, None), "max_bin": (2, None), "max_cat_to_onehot": (1, None), "max_cat_threshold": (1, None),
    "min_child_weight": (0, None), "reg_lambda": (0, None), "reg_alpha": (0, None), "max_delta_step": (0, None), "subsample": (0, 1), "colsample_bytree": (0, 1), "colsample_bylevel": (0, 1),
    "colsample_bynode": (0, 1), "rate_drop": (0, 1), "skip_drop": (0, 1), "scale_pos_weight": (0, None), "num_parallel_tree": (1, None), "tweedie_variance_power": (1, 2), "lambdarank_bias_norm": (0, None),
    "verbosity": (0, 3), "top_k": (0, None), "tolerance": (0, None),
}
CHOICES = {
    "booster": {"gbtree", "gblinear", "dart"}, "tree_method": {"auto", "hist", "approx", "exact"}, "grow_policy": {"depthwise", "lossguide"}, "sampling_method": {"uniform", "gradient_based"},
    "process_type": {"default", "update"}, "multi_strategy": {"one_output_per_tree", "multi_output_tree"}, "sample_type": {"uniform", "weighted"}, "normalize_type": {"tree", "forest"},
    "feature_selector": {"cyclic", "shuffle", "thrifty", "greedy", "random"}, "aft_loss_distribution": {"normal", "logistic", "extreme"}, "lambdarank_pair_method": {"topk", "mean"},
}


def resolve(given: dict | None) -> dict:
    """All parameters with defaults filled in. Unknown names raise with
    validate_parameters and are ignored otherwise; out-of-range values raise."""
    given = {ALIASES.get(k, k): v for k, v in (given or {}).items() if v is not None}
    unknown = set(given) - set(DEFAULTS)
    if unknown and given.get("validate_parameters"):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    base = DEFAULTS | (LINEAR_DEFAULTS if given.get("booster") == "gblinear" else {})
    out = base | {k: v for k, v in given.items() if k in DEFAULTS}
    if out["booster"] == "dart":
        out["booster"] = "gbtree"
    for k, (lo, hi) in RANGES.items():
        if out[k] is not None and (lo is not None and out[k] < lo or hi is not None and out[k] > hi):
            raise ValueError(f"{k}={out[k]} is outside [{lo}, {hi}]")
    for k, allowed in CHOICES.items():
        if k in given and given[k] not in allowed:
            raise ValueError(f"{k} must be one of {sorted(allowed)}")
    if out["booster"] == "gbtree" and out["grow_policy"] == "depthwise" and not out["max_depth"] and not out["max_leaves"]:
        raise ValueError("max_depth and max_leaves can't both be 0")
    if out["tree_method"] == "exact" and not out["max_depth"]:
        raise ValueError("exact needs a max_depth")
    out["_given"] = set(given)
    return out
