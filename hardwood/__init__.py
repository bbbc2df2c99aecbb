"""hardwood: game-log analytics and corpus preparation written as Spark plans."""
