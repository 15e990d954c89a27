"""Plan building blocks: ordered passes that survive a huge group, and derived inputs."""
