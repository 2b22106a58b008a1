"""Query plans: every reference statement as a DataFrame operator
``op(star, **params) -> DataFrame`` over a star-schema dict."""
