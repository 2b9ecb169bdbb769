"""panelspan: entity time-series panels on Spark, as lazy DataFrame plans."""
