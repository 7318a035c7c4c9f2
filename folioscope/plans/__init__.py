"""Plan shapes for joins, quantiles, ranks and neighbour searches that hold up under skew."""
