"""crowdcover: how well is a published record covered by the crowd it could belong to?

Disclosure-risk measurement and control of tables on Spark. Every public function takes and
returns DataFrames; only small, size-checked things (lists of classes, bounds, totals) reach
the driver.
"""

__version__ = "0.1.0"
