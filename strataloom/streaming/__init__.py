"""Change events as streams: debounce, deferral, queue caps, cooldown."""
