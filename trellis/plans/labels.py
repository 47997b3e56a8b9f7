"""Display-label dimension (P11, V8): metric titles by language.

A tiny table joined by broadcast to any long metric table, so figure titles and
legends come out of a query rather than a dictionary lookup in a plotting loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Metric titles per language, as the figures label them.
# (lang, key, title)
TITLES = [
    ("en", "R2 Score", "Prediction Accuracy (R2 Score)"),
    ("en", "Train Time (s)", "Computation Cost (Training Time)"),
    ("en", "SHAP Time (s)", "Interpretability Cost (SHAP Calculation Time)"),
    ("en", "RMSE", "RMSE (Lower is Better)"),
    ("en", "MAE", "MAE (Lower is Better)"),
    ("en", "Accuracy", "Accuracy (Higher is Better)"),
    ("en", "F1 Score", "F1 Score (Higher is Better)"),
    ("en", "ROC AUC", "ROC AUC (Higher is Better)"),
    ("en", "Brier Score", "Brier Score (Lower is Better)"),
    ("en", "Overfitting", "Overfitting Factor (Lower is Better)"),
    ("en", "RMSE (Train)", "RMSE (Train)"),
    ("en", "RMSE (Test)", "RMSE (Test)"),
    ("en", "R2 (Test)", "R2 Score (Test)"),
    ("en", "Model", "Model"),
    ("en", "Coefficient", "Coefficient"),
    ("en", "Feature", "Feature"),
    ("ja", "R2 Score", "予測精度 (R2スコア)"),
    ("ja", "Train Time (s)", "計算コスト (学習時間)"),
    ("ja", "SHAP Time (s)", "解釈性コスト (SHAP計算時間)"),
    ("ja", "RMSE", "RMSE (低いほど良い)"),
    ("ja", "MAE", "MAE (低いほど良い)"),
    ("ja", "Accuracy", "正解率（高いほど良い）"),
    ("ja", "F1 Score", "F1スコア（高いほど良い）"),
    ("ja", "ROC AUC", "ROC AUC（高いほど良い）"),
    ("ja", "Brier Score", "Brierスコア（低いほど良い）"),
    ("ja", "Overfitting", "過学習係数（低いほど良い）"),
    ("ja", "RMSE (Train)", "RMSE (訓練)"),
    ("ja", "RMSE (Test)", "RMSE (テスト)"),
    ("ja", "R2 (Test)", "R2スコア (テスト)"),
    ("ja", "Model", "モデル"),
    ("ja", "Coefficient", "係数"),
    ("ja", "Feature", "特徴量"),
]

# Our metric column names -> the display keys above.
METRIC_KEYS = {"rmse": "RMSE", "mae": "MAE", "r2": "R2 Score", "accuracy": "Accuracy",
               "f1": "F1 Score", "roc_auc": "ROC AUC", "brier": "Brier Score",
               "overfitting": "Overfitting", "rmse_train": "RMSE (Train)",
               "rmse_test": "RMSE (Test)", "r2_test": "R2 (Test)",
               "train_time_s": "Train Time (s)", "explain_time_s": "SHAP Time (s)"}


def titles_table(spark: SparkSession) -> DataFrame:
    """``(lang, metric, title)`` with our metric names (32 rows at most)."""
    rows = [(lang, m, title) for m, key in METRIC_KEYS.items()
            for lang, k, title in TITLES if k == key]
    return spark.createDataFrame(rows, "lang string, metric string, title string")


def sql_values() -> str:
    """The same table as an SQL ``VALUES`` list for the DuckDB twins."""
    rows = [(lang, m, title) for m, key in METRIC_KEYS.items()
            for lang, k, title in TITLES if k == key]
    body = ",\n  ".join("('%s', '%s', '%s')" % r for r in rows)
    return f"(VALUES\n  {body}) AS t(lang, metric, title)"
