"""Column types of the input files and stored tables."""

# Layouts of the four training files.
CARDS = "Time double, " + ", ".join(f"V{i} double" for i in range(1, 29)) + ", Amount double, Class int"
CENSUS = (
    "age int, workclass string, fnlwgt int, education string, `educational-num` int, `marital-status` string, "
    "occupation string, relationship string, race string, gender string, `capital-gain` int, `capital-loss` int, "
    "`hours-per-week` int, `native-country` string, income string"
)
STOCKS = "date date, open double, high double, low double, close double, volume long, Name string"
EXPENSES = "amount string, merchant string, description string, category string"
TRAINING_FILES = {"cards": CARDS, "census": CENSUS, "stocks": STOCKS, "expenses": EXPENSES}

# Layouts and keys of the stored tables.
TABLES = {
    "users": (
        "user_id string, name string, age int, annual_income double, monthly_income double, location string, "
        "occupation string, credit_score int, savings_goal double, risk_tolerance string, created_date date, "
        "updated_at timestamp"
    ),
    "transactions": (
        "id long, user_id string, date date, type string, category string, amount double, description string, "
        "merchant string, balance_after double, created_at timestamp"
    ),
    "monthly_summaries": (
        "id long, user_id string, year_month string, total_amount double, transaction_count int, first_date date, "
        "last_date date, total_income double, total_expenses double, net_savings double, created_at timestamp"
    ),
    "portfolios": (
        "id long, user_id string, symbol string, asset_type string, shares double, purchase_price double, "
        "current_price double, purchase_date date, current_value double, total_return double, "
        "return_percentage double, created_at timestamp, updated_at timestamp"
    ),
    "stock_data": (
        "id long, symbol string, date date, open_price double, high_price double, low_price double, "
        "close_price double, volume long, data_source string, fetched_at timestamp"
    ),
    "crypto_data": (
        "id long, symbol string, date date, open_price double, high_price double, low_price double, "
        "close_price double, volume double, market_cap double, data_source string, fetched_at timestamp"
    ),
    "current_prices": (
        "id long, symbol string, asset_type string, current_price double, data_source string, updated_at timestamp"
    ),
}
TABLE_KEYS = {
    "users": ["user_id"],
    "transactions": ["id"],
    "monthly_summaries": ["user_id", "year_month"],
    "portfolios": ["id"],
    "stock_data": ["symbol", "date"],
    "crypto_data": ["symbol", "date"],
    "current_prices": ["symbol", "asset_type"],
}
