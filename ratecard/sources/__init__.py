from ratecard.sources.io import read_table, write_table, ACCOUNT_SCHEMA, QUOTE_SCHEMA  # noqa: F401
from ratecard.sources.testdata import load_accounts, load_quotes, load_table  # noqa: F401
