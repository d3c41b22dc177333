"""Calendar regimes, variable groups, tuning grids and defaults."""

from __future__ import annotations

TARGET = "INDPRO"
DATE_COLUMN = "sasdate"
SAMPLE_START, SAMPLE_END = "1968-03-01", "2025-09-01"
EVALUATION_START = "1976-07-01"

# Evaluation regimes, both ends inclusive.
REGIMES = {
    "pre-GFC": ("1900-01-01", "2007-07-31"),
    "GFC": ("2007-08-01", "2009-06-30"),
    "post-GFC/pre-COVID": ("2009-07-01", "2020-02-29"),
    "COVID": ("2020-03-01", "2023-04-30"),
    "post-COVID": ("2023-05-01", "2100-01-01"),
}

# The same periods under the names used for descriptive output.
DISPLAY_NAMES = ("Pre-GFC", "GFC", "Post-GFC Recovery", "SARS-CoV-2 Pandemic", "Post-Pandemic Era")
DISPLAY_REGIMES = dict(zip(DISPLAY_NAMES, REGIMES.values()))

# Predictors of the domain-informed selection.
DOMAIN_GROUPS = {
    "Industrial_Activity": ("IPMANSICS", "CUMFNS"),
    "Labor_Market": ("UNRATE", "CLAIMSx", "CES0600000007"),
    "Consumption_Orders": ("PERMIT", "ANDENOx", "CMRMTSPLx"),
    "Financial": ("BUSLOANS", "M2REAL", "COMPAPFFx", "T10YFFM"),
    "Housing_Consumer_Sentiment": ("HOUST",),
    "Prices": ("OILPRICEx",),
    "Stock market": ("S&P 500",),
}

# Columns left out before and after screening.
SPARSE_COLUMNS = ("UMCSENTx",)
NON_STATIONARY_COLUMNS = ("HOUSTNE", "HOUSTMW", "PERMITMW")

# Hyper-parameter grids.
PENALTIES = (0.001, 0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
L1_RATIOS = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0)
HUBER_EPSILONS = (1.0, 1.1, 1.35, 1.5, 1.75, 2.0)
SGD_L1_RATIOS = (0.15, 0.5, 0.85)
NETWORK_PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
NETWORK_SIZES = {
    "univariate": (1, 6, 10, 13, 26, 100),
    "multivariate": (1, 9, 18, 20, 37),
    "multivariate_domain": (1, 7, 14, 20, 28),
}
MODEL_TYPES = ("univariate", "multivariate", "multivariate_domain")
MODEL_CLASSES = ("elasticnet", "huber", "lightgbm", "mlp", "sgd")
MODEL_NAMES = {
    "elasticnet": "Elastic Net",
    "huber": "Huber Regression",
    "sgd": "SGD Regression",
    "lightgbm": "LightGBM",
    "mlp": "MLP",
}
TYPE_NAMES = {"univariate": "Univariate", "multivariate": "Multivariate", "multivariate_domain": "DI-Multivariate"}


def _product(**values) -> list[dict]:
    """All combinations, last name fastest; list order is the tie-break order of the tuning."""
    points: list[dict] = [{}]
    for name, choices in values.items():
        points = [{**p, name: c} for p in points for c in choices]
    return points


def model_grid(model: str, model_type: str = "univariate") -> list[dict]:
    """Hyper-parameter points of a model class in tuning order."""
    if model == "elasticnet":
        return _product(alpha=PENALTIES, l1_ratio=L1_RATIOS)
    if model == "huber":
        return _product(alpha=PENALTIES, epsilon=HUBER_EPSILONS)
    if model == "sgd":
        epsilons = (0.1, *HUBER_EPSILONS) if model_type == "univariate" else HUBER_EPSILONS
        return _product(alpha=PENALTIES, epsilon=epsilons, l1_ratio=SGD_L1_RATIOS)
    if model == "mlp":
        return _product(hidden=NETWORK_SIZES[model_type], activation=("relu", "tanh"), alpha=NETWORK_PENALTIES)
    if model == "lightgbm":
        return _product(max_depth=(3, 5, -1), n_estimators=(100, 500))
    raise ValueError(f"unknown model class {model!r}")
