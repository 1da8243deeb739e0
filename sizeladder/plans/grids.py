"""Hyperparameter grids that ship with the engine."""

# The grids of the reference, by model.
_ALPHAS = [1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1, 10, 100, 1e3, 1e4, 1e5]
_WIDTHS = [10, 20, 50, 100, 500, 1000]
_GAMMAS = [0.00000003, 0.00000539, 0.00097656, 0.17677670, 32.0]
_FOREST = {"n_estimators": [500], "max_depth": [3, 5, 10, 100], "max_features": [0.01, 0.1, 0.5, 1]}
_BOOST = {"n_estimators": [2000], "subsample": [0.5, 1.0], "learning_rate": [0.1], "max_features": [1.0, 0.5]}


def _both(name: str, grid: dict) -> dict:
    return {f"{name}-cls": grid, f"{name}-reg": grid}


GRIDS = {
    "default": {
        "majority-cls": {}, "mean-reg": {}, "logistic-regression-cls": {}, "ols-reg": {},
        **_both("ridge", {"alpha": _ALPHAS}),
        **_both("random-forest", _FOREST),
        **_both("xgb", {**_BOOST, "max_depth": [2, 3, 4, 6, 8, 10]}),
        **_both("rbf-kernel-svm", {"C": _ALPHAS, "gamma": _GAMMAS}),
        **_both("poly-kernel-svm", {"C": _ALPHAS, "degree": [1, 2, 3, 5, 10]}),
        **_both("pca-ridge", {"pca__n_components": _WIDTHS, "ridge__alpha": _ALPHAS}),
        **_both("rfe-ridge", {"rfe__n_features_to_select": _WIDTHS, "ridge__alpha": _ALPHAS}),
    },
    "minimal": {
        "majority-cls": {}, "mean-reg": {}, "logistic-regression-cls": {}, "ols-reg": {},
        **_both("ridge", {"alpha": [0.1, 1]}),
        **_both("random-forest", {"n_estimators": [50], "max_depth": [3]}),
        **_both("xgb", {**_BOOST, "max_depth": [3]}),
        **_both("rbf-kernel-svm", {"C": [0.1, 1], "gamma": [0.1]}),
        **_both("poly-kernel-svm", {"C": [0.1, 1], "degree": [2]}),
        **_both("pca-ridge", {"pca__n_components": [10], "ridge__alpha": [0.1, 1]}),
        **_both("rfe-ridge", {"rfe__n_features_to_select": [10], "ridge__alpha": [0.1, 1]}),
    },
}
