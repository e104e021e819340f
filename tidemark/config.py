"""Parameters per universe and frequency, kept as data."""

from __future__ import annotations

from dataclasses import dataclass

UNIVERSES = ("dowjones", "nasdaq", "russell", "sp500")
FREQUENCIES = ("daily", "weekly", "monthly")


@dataclass(frozen=True)
class Frequency:
    name: str
    target: str  # next-period return
    previous_return: str
    previous_volume: str
    averages: tuple[int, int, int]  # price average windows, short to long
    unit: str  # used in the average column names
    size_bins: int  # quantile bins in the size summary

    @property
    def average_columns(self) -> tuple[str, ...]:
        return tuple(f"{n}_{self.unit}_ma" for n in self.averages)


DAILY = Frequency("daily", "tomorrow_return", "yesterday_return", "yesterday_volume", (10, 20, 30), "day", 10)
WEEKLY = Frequency("weekly", "next_week_return", "last_week_return", "last_week_volume", (2, 3, 4), "week", 10)
MONTHLY = Frequency("monthly", "next_month_return", "last_month_return", "last_month_volume", (1, 2, 3), "month", 3)
BY_NAME = {f.name: f for f in (DAILY, WEEKLY, MONTHLY)}

# Groups of the size ranking.
SIZE_GROUPS = {
    ("dowjones", "daily"): 30, ("nasdaq", "daily"): 10, ("russell", "daily"): 10, ("sp500", "daily"): 10,
    ("dowjones", "weekly"): 30, ("nasdaq", "weekly"): 5, ("russell", "weekly"): 10, ("sp500", "weekly"): 10,
    ("dowjones", "monthly"): 30, ("nasdaq", "monthly"): 5, ("russell", "monthly"): 30, ("sp500", "monthly"): 5,
}

# An industry is kept when it has more firms than this.
INDUSTRY_MIN_FIRMS = {
    ("dowjones", "daily"): 10, ("russell", "daily"): 15, ("sp500", "daily"): 10,
    ("russell", "weekly"): 10, ("sp500", "weekly"): 10,
}

# Fixed value: news counts from this on are left out of the count tables listed below.
NEWS_COUNT_LIMIT = 21
NEWS_COUNT_LIMITED = {
    ("dowjones", "weekly"), ("nasdaq", "weekly"),
    ("dowjones", "monthly"), ("nasdaq", "monthly"), ("russell", "monthly"), ("sp500", "monthly"),
}

# Total news a rule asks for (more than k) where it differs from "any news".
NEWS_GATES = {
    ("dowjones", "weekly"): {1: 2, 3: 2, 5: 2, 10: 2},
    ("nasdaq", "weekly"): {},
    ("russell", "weekly"): {3: 2, 5: 1, 10: 3},
    ("sp500", "weekly"): {},
    ("dowjones", "monthly"): {1: 10, 3: 2, 5: 2, 10: 2},
    ("nasdaq", "monthly"): {},
    ("russell", "monthly"): {1: 0, 3: 4, 5: 2, 10: 3},
    ("sp500", "monthly"): {},
}

# Labels of return bands, lowest first.
DECILE_LABELS = (
    "Bottom 10%", "10-20%", "20-30%", "30-40%", "40-50%",
    "50-60%", "60-70%", "70-80%", "80-90%", "Top 10%",
)

# Depth and complexity parameter of the regression tree, and where they differ.
TREE = {"depth": 30, "cp": 0.0001}
TREE_OF = {("russell", "daily"): {"depth": 20, "cp": 0.001}}

# Universes whose rows with any missing value go before the model columns are chosen.
WHOLE_ROWS_ONLY = {"russell", "sp500"}

# Share of train rows, and the quantiles the tree's train rows are trimmed to.
TRAIN_SHARE = 0.7
TRIM = (0.025, 0.975)

BACKTEST_START = "2023-02-13"
INITIAL_INVESTMENT = 100000.0
