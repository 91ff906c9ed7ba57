"""Everything here must stay equal for results to stay comparable.

Word lists, ranges, scales and formats of the census method.  They are data,
not logic; the operators import them by name.
"""

# --- fixed values: technology registry (library, modules, category, package) ---
REGISTRY = (
    ("numpy", ("numpy",), "array", "numpy"),
    ("pandas", ("pandas",), "array", "pandas"),
    ("polars", ("polars",), "array", "polars"),
    ("scipy", ("scipy",), "scientific", "scipy"),
    ("statsmodels", ("statsmodels",), "scientific", "statsmodels"),
    ("sympy", ("sympy",), "scientific", "sympy"),
    ("scikit_learn", ("sklearn",), "ml", "scikit-learn"),
    ("xgboost", ("xgboost",), "ml", "xgboost"),
    ("lightgbm", ("lightgbm",), "ml", "lightgbm"),
    ("tensorflow", ("tensorflow",), "deep_learning", "tensorflow"),
    ("keras", ("keras",), "deep_learning", "keras"),
    ("pytorch", ("torch",), "deep_learning", "torch"),
    ("pytorch_lightning", ("pytorch_lightning", "lightning"), "deep_learning", "lightning"),
    ("jax", ("jax", "flax"), "deep_learning", "jax"),
    ("transformers", ("transformers",), "deep_learning", "transformers"),
    ("matplotlib", ("matplotlib", "pylab"), "plotting", "matplotlib"),
    ("seaborn", ("seaborn",), "plotting", "seaborn"),
    ("plotly", ("plotly",), "plotting", "plotly"),
    ("altair", ("altair",), "plotting", "altair"),
    ("bokeh", ("bokeh",), "plotting", "bokeh"),
    ("holoviews", ("holoviews",), "plotting", "holoviews"),
    ("plotnine", ("plotnine",), "plotting", "plotnine"),
    ("ipywidgets", ("ipywidgets",), "interactive", "ipywidgets"),
    ("anywidget", ("anywidget",), "interactive", "anywidget"),
    ("ipyleaflet", ("ipyleaflet",), "interactive", "ipyleaflet"),
    ("streamlit", ("streamlit",), "interactive", "streamlit"),
    ("marimo", ("marimo",), "notebook_tech", "marimo"),
    ("voila", ("voila",), "notebook_tech", "voila"),
    ("panel", ("panel",), "notebook_tech", "panel"),
    ("quarto", ("quarto",), "notebook_tech", "quarto"),
    ("papermill", ("papermill",), "notebook_tech", "papermill"),
    ("nbconvert", ("nbconvert",), "notebook_tech", "nbconvert"),
    ("jupyter_ai", ("jupyter_ai",), "llm", "jupyter-ai"),
    ("langchain", ("langchain", "langchain_core", "langchain_community"), "llm", "langchain"),
    ("llamaindex", ("llama_index",), "llm", "llama-index"),
    ("openai", ("openai",), "llm", "openai"),
    ("anthropic", ("anthropic",), "llm", "anthropic"),
    ("duckdb", ("duckdb",), "data_io", "duckdb"),
    ("pyarrow", ("pyarrow",), "data_io", "pyarrow"),
    ("sqlalchemy", ("sqlalchemy",), "data_io", "sqlalchemy"),
    ("requests", ("requests",), "data_io", "requests"),
    ("dask", ("dask",), "data_io", "dask"),
)

# --- fixed values: strata ---
# (label, lowest stars, highest stars or None)
STAR_BUCKETS = (
    ("long_tail", 1, 5),
    ("small", 6, 25),
    ("medium", 26, 100),
    ("popular", 101, 500),
    ("very_popular", 501, 2000),
    ("head", 2001, None),
)
# (label, text, lowest KB, highest KB or None); 5000 lies in two ranges
SIZE_BUCKETS = (
    ("size:<500", 0, 499),
    ("size:500..5000", 500, 5000),
    ("size:5000..50000", 5000, 50000),
    ("size:>50000", 50001, None),
)
COHORT_STAR_BANDS = (
    ("notable", 51, None),
    ("mid", 5, 50),
    ("long_tail", 0, 4),
)
TOPICS = (
    "data-science",
    "machine-learning",
    "deep-learning",
    "data-analysis",
    "data-visualization",
    "tutorial",
    "research",
    "physics",
    "bioinformatics",
    "finance",
    "nlp",
    "computer-vision",
    "statistics",
    "education",
)
FIRST_CREATED_YEAR = 2015
FIRST_COHORT_YEAR = 2013

# --- fixed values: run limits ---
TARGET_DOCUMENTS = 400
REPO_SAMPLE_SIZE = 120
MAX_FILES_PER_REPO = 5
MAX_FILE_BYTES = 4_000_000
RESULT_CAP = 1000

# --- fixed values: document metadata ---
EXTENSION_LABELS = (
    ("celltoolbar", "celltoolbar"),
    ("toc", "toc"),
    ("varInspector", "varInspector"),
    ("hide_input", "hide_input"),
    ("nbextensions", "nbextensions"),
    ("rise", "rise"),
    ("widgets", "jupyter-widgets"),
    ("papermill", "papermill"),
    ("colab", "google-colab"),
)
STANDARD_METADATA_KEYS = ("kernelspec", "language_info")
WIDGET_MIME = "application/vnd.jupyter.widget-view+json"

# --- fixed values: report and chart selections ---
KEY_LIBRARIES = (
    "numpy", "pandas", "matplotlib", "scikit_learn", "pytorch", "tensorflow",
    "keras", "transformers", "seaborn", "plotly", "scipy", "ipywidgets",
)
TREND_LIBRARIES = (
    "numpy", "pandas", "matplotlib", "scikit_learn", "seaborn", "pytorch",
    "tensorflow", "transformers",
)
SCORE_COLUMNS = (
    "notebook_size_index",
    "narrative_index",
    "reproducibility_score",
    "visualization_density",
    "interactive_widget_score",
    "scientific_computing_score",
    "ml_usage_score",
    "complexity_score",
    "educational_score",
    "documentation_density",
)
TREND_INDICATORS = (
    "mean_total_cells",
    "mean_code_cells",
    "mean_markdown_cells",
    "pct_executed_in_order",
    "pct_with_widgets",
    "reproducibility_score_mean",
    "narrative_index_mean",
    "complexity_score_mean",
)
STRUCTURE_COLUMNS = (
    "mean_total_cells",
    "mean_code_cells",
    "mean_markdown_cells",
    "mean_total_lines",
    "mean_outputs",
    "pct_with_output",
    "pct_executed_in_order",
    "pct_with_widgets",
    "pct_with_python_version",
)
# Trend sentences: the direction between the first and the last year, by a change beyond so many points.
TREND_POINTS = 2
TREND_DIRECTIONS = ("rose", "fell", "stayed roughly flat")
TREND_SENTENCE = "{library} {direction} from {first}% in {first_year} to {last}% in {last_year} (peak {peak}% in {peak_year})."
# --- end of fixed values ---

LIBRARIES = tuple(sorted(row[0] for row in REGISTRY))
CATEGORY_OF = {row[0]: row[2] for row in REGISTRY}
MODULE_TO_LIBRARY = {module: row[0] for row in REGISTRY for module in row[1]}
