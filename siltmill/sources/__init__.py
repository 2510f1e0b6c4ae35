"""Where rows come from and go to: clickstream files, feeds, object stores, Kafka."""
