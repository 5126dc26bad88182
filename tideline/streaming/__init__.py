"""No stream operators exist in the study this package serves, so none are defined here.

The row-local operators (column functions, filters, melt, joins to a static dimension) take a
streaming DataFrame as they take a static one; ``tests/test_streaming.py`` holds them to that.
"""
