"""Document analytics on Spark DataFrames."""

from pagewright.session import ship_package

ship_package()
