"""Question routing by rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that send a question to a route, with their inflections; rules are tried in this order.
ROUTES = (
    ("vector", (
        "bild", "bilder", "bildern", "bildes", "grafik", "grafiken", "screenshot", "screenshots", "diagramm", "diagramme", "diagrammen", "chart", "charts",
        "image", "images", "picture", "pictures", "diagram", "diagrams", "figure", "figures",
    )),
    ("sql", (
        "tabelle", "tabellen", "summe", "summen", "anzahl", "durchschnitt", "durchschnitte", "durchschnittlich", "table", "tables", "sum", "sums",
        "count", "counts", "average", "averages", "total", "totals",
    )),
    ("vector", (
        "dokument", "dokumente", "dokumenten", "dokuments", "kapitel", "kapiteln", "kapitels", "seite", "seiten", "document", "documents", "chapter", "chapters",
        "page", "pages", "source", "sources",
    )),
)
FALLBACK_ROUTE = "direct"


def route(question: Column, rules: Sequence[tuple[str, Sequence[str]]] = ROUTES) -> Column:
    """Route of a question: the first rule one of whose words stands in it as a whole word."""
    chosen = F.lit(FALLBACK_ROUTE)
    for name, terms in reversed(rules):
        pattern = rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(terms)})($|[^\p{{L}}\p{{N}}])"
        chosen = F.when(F.lower(question).rlike(pattern), name).otherwise(chosen)
    return chosen
