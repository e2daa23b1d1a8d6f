"""Vocabularies of the generated tables."""

# Countries and their tax rates in basis points, in the same order.
COUNTRIES = (
    "United States", "China", "India", "Germany", "United Kingdom", "France", "Japan", "Brazil", "Canada", "Italy",
    "Russia", "South Korea", "Australia", "Spain", "Mexico", "Indonesia", "Netherlands", "Saudi Arabia", "Turkey", "Switzerland",
    "Poland", "Sweden", "Belgium", "Argentina", "Norway", "Austria", "Ireland", "Israel", "UAE", "Singapore",
    "Denmark", "Malaysia", "Philippines", "South Africa", "Egypt", "Finland", "Chile", "Portugal", "Czechia", "Mongolia",
)
TAX_RATES = (
    725, 1300, 1800, 1900, 2000, 2000, 1000, 1700, 500, 2200,
    2000, 1000, 1000, 2100, 1600, 1100, 2100, 1500, 2000, 770,
    2300, 2500, 2100, 2100, 2500, 2000, 2300, 1700, 500, 800,
    2500, 600, 1200, 1500, 1400, 2400, 1900, 2300, 2100, 1000,
)

# The other vocabularies and the edge values.
SEGMENTS = ("consumer", "corporate", "small_business", "enterprise", "government", "education")
EVENT_TYPES = ("view", "click", "search", "add_to_cart", "purchase", "refund", "login", "logout")
COLORS = ("red", "green", "blue", "black", "white", "yellow", "purple", "orange")
SIZES = ("xs", "s", "m", "l", "xl")
EDGE_COUNTRIES = ("", "Côte d'Ivoire \U0001f1e8\U0001f1ee")
EDGE_CATEGORIES = ("Cafe\u0301", "Caf\u00e9")
PADDING = "abcdefghij"
