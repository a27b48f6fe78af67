"""Player-season analytics, draft valuation and live boards as Spark jobs."""
